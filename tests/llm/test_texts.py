"""Operators on whole texts against brute-force versions, with nulls, empty and long texts, ties, repeated rows and clashing names."""

from __future__ import annotations

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sparktick.llm.bpe import TrieEncoder, encode_decode
from sparktick.llm.components import connected_components
from sparktick.llm.fingerprints import containment, distinct_count, fingerprint_documents, merged, sketched
from sparktick.llm.packing import best_fit, cut, pack_documents
from sparktick.llm.sharding import histogram_shards
from sparktick.llm.simhash import BKTree, simhash_components
from sparktick.llm.substrings import SuffixAutomaton, remove_repeats
from sparktick.llm.tokens import TextEncoder

from .conftest import SCHEMA, edge_texts, prose, rows

WORD = re.compile(r"[^\x20\x09-\x0D]+")
BYTE_BPE, WORD_BPE = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json"))


def removed(texts, window=20):
    """Brute force of the passage rule: (n_words, n_removed, sha256) for each (doc_id, text); null ids first, repeated rows once."""
    seen, out = set(), {}
    for i, t in sorted(set(texts), key=lambda x: (x[0] is not None, x[0] or 0)):
        words = WORD.findall(t or "")
        gone = [False] * len(words)
        for k in range(len(words) - window + 1):
            w = tuple(words[k:k + window])
            if w in seen:
                gone[k:k + window] = [True] * window
            seen.add(w)
        kept = " ".join(w for w, g in zip(words, gone) if not g)
        out[i] = (len(words), sum(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


@pytest.mark.parametrize("hot", [4096, 0])
def test_passages(edge, hot):
    got = remove_repeats(edge, hot=hot).collect()
    want = removed(edge_texts())
    assert len(got) == len(edge_texts())
    assert all(want[r.doc_id] == (r.n_words, r.n_removed, r.kept_sha256) for r in got)
    texts = dict(edge_texts())
    assert all(r.kept == texts[r.doc_id] for r in got if not r.n_removed)
    assert sum(r.n_removed for r in got) > 300


def test_passages_on_few_words_and_equal_ids(spark):
    texts = [(i, prose(i % 5, 60, vocabulary=3)) for i in range(40)] + [(7, prose(90, 40)), (100, prose(90, 40))]
    got = {(r.doc_id, r.n_words): r for r in remove_repeats(spark.createDataFrame(rows(texts), SCHEMA)).collect()}
    # Of the two texts of id 7 the order is that of a hash; both come before 100.
    assert got[100, 40].n_removed == 40 and got[7, 40].n_removed == 0
    want = removed(texts[:40])
    assert all(want[i][:2] == (got[i, 60].n_words, got[i, 60].n_removed) for i in range(40) if i != 7)


def test_automaton():
    text = "a b a b b a c a b a b b".split()
    tree = SuffixAutomaton()
    tree.add(text[:5])
    tree.add(text[5:9])
    for query in ("b b a c a".split(), "a b a b b a".split(), "c a b b".split()):
        want = []
        parts = [text[:5], text[5:9]]
        factors = {tuple(p[i:j]) for p in parts for i in range(len(p)) for j in range(i + 1, len(p) + 1)}
        for end in range(1, len(query) + 1):
            want.append(max((n for n in range(1, end + 1) if tuple(query[end - n:end]) in factors), default=0))
        assert tree.matching_statistics(query) == want


@pytest.mark.parametrize("shards", [8, 3])
def test_sharding(edge, spark, shards):
    got = histogram_shards(edge, shards).collect()
    texts = edge_texts()
    assert sorted((r.doc_id or -1, r.size, r.text_crc32) for r in got) == sorted(
        (i or -1, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in texts)
    where = collections.defaultdict(set)
    for r in got:
        where[r.text].add(r.shard)
    assert max(map(len, where.values())) == 1
    for s in range(shards):
        slots = sorted(r.slot for r in got if r.shard == s)
        assert slots == list(range(len(slots)))
    many = [(i, prose(i, 30)) for i in range(600)] + [(1000 + i, prose(0, 30)) for i in range(60)]
    got = histogram_shards(spark.createDataFrame(rows(many), SCHEMA), 4, rows_per_bin=20).collect()
    sizes = [sum(r.size for r in got if r.shard == s) for s in range(4)]
    assert max(sizes) - min(sizes) < 0.02 * sum(sizes)
    assert len({r.shard for r in got if r.text == prose(0, 30)}) == 1
    assert sorted(r.slot for r in got if r.shard == 2) == list(range(sum(r.shard == 2 for r in got)))


def test_sharding_splits_what_no_shard_can_hold(spark):
    one = histogram_shards(spark.createDataFrame(rows([(i, "same text") for i in range(800)]), SCHEMA), 4).collect()
    counts = collections.Counter(r.shard for r in one)
    assert sum(counts.values()) == 800 and min(counts.values()) > 120


def test_packing(edge):
    library = Tokenizer.from_file(BYTE_BPE)
    got = pack_documents(edge, BYTE_BPE).collect()
    texts = {i: library.encode(t or "", add_special_tokens=False).ids + [0] for i, t in edge_texts()}
    assert sum(r.length for r in got) == sum(len(texts[i]) for i, _ in edge_texts())
    bins = collections.defaultdict(list)
    for r in got:
        ids = np.asarray(texts[r.doc_id][r.start:r.start + r.length], "<u4")
        assert len(ids) == r.length and zlib.crc32(ids.tobytes()) == r.ids_crc32
        bins[r.sequence_id].append((r.offset, r.length))
    for pieces in bins.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(bins) <= -(-sum(map(len, (texts[i] for i, _ in edge_texts()))) // 2048) + 2


@pytest.mark.parametrize("block", [20_000, 300])
def test_packing_does_not_depend_on_the_order_of_the_table(spark, monkeypatch, block):
    """Short and long texts apart or mixed: as few sequences as there are long texts. Small blocks make a tree, and slices of nodes."""
    monkeypatch.setattr("sparktick.llm.packing.BLOCK_ITEMS", block)
    rng = random.Random(3)
    texts = [prose(i, rng.randint(2, 25)) for i in range(2000)] + [prose(i, rng.randint(500, 560)) for i in range(200)]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for frame in (table.repartitionByRange(12, F.length("text")), table.repartition(12)):
        rows = pack_documents(frame, BYTE_BPE).collect()
        used = collections.defaultdict(list)
        for r in rows:
            used[r.sequence_id].append((r.offset, r.length))
        for places in used.values():
            at = 0
            for offset, length in sorted(places):
                assert offset == at
                at += length
            assert at <= 2048
        least = -(-sum(r.length for r in rows) // 2048)
        assert len(rows) == 2200 and len(used) <= max(200, 1.02 * least) + (0 if block > 10_000 else 6)


def test_best_fit():
    bins, places, fills = best_fit([5, 5, 4, 4, 1, 1, 10], 10)
    assert fills == [10, 10, 10] and sorted(zip(bins, places))[0] == (0, 0)
    assert best_fit([6, 6, 6], 10)[2] == [6, 6, 6]
    assert cut(5000, 2048) == [(0, 904), (904, 2048), (2952, 2048)] and cut(2048, 2048) == [(0, 2048)] and cut(1, 2048) == [(0, 1)]


def test_underfull_bins_end(spark):
    half = [(i, prose(i, 420)) for i in range(30)]  # no two fit into one sequence
    got = pack_documents(spark.createDataFrame(rows(half), SCHEMA), BYTE_BPE, capacity=2048).collect()
    assert len(got) == 30 and all(r.length <= 2048 for r in got)


def test_bpe(edge):
    library = Tokenizer.from_file(WORD_BPE)
    texts = dict(edge_texts())
    got = encode_decode(edge, WORD_BPE).collect()
    assert len(got) == len(edge_texts())
    for r in got:
        ids = library.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
        assert np.frombuffer(r.ids, "<u4").tolist() == ids and r.n_tokens == len(ids)
        assert r.decoded == library.decode(ids, skip_special_tokens=False)
    short = encode_decode(edge, WORD_BPE, digests=True).collect()
    assert {(r.doc_id, r.ids_sha256) for r in short} == {(r.doc_id, hashlib.sha256(r.ids).hexdigest()) for r in got}


def test_trie_words():
    own, library = TrieEncoder(WORD_BPE), Tokenizer.from_file(WORD_BPE)
    words = {w for s in range(40) for w in prose(s, 50).split()} | {"a", "ab", "abc", "thing", "things", "don", "zzzzzzzzzz", "internationalisation"}
    assert all(ids == library.encode(w, add_special_tokens=False).ids for w, ids in own.encode_words(words).items())


@pytest.mark.parametrize("text", ["a  b", " a b ", "x\n\ny z", "a\tb", "<|endoftext|> a", "it's 12 o'clock\nyes", "a b c", "\x1c x", "日本 語\né è"])
def test_text_encoder(text):
    library = Tokenizer.from_file(BYTE_BPE)
    assert np.frombuffer(TextEncoder(BYTE_BPE).encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def fingerprint(text, width=3):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    runs = [" ".join(words[k:k + width]) for k in range(len(words) - width + 1)] or ([" ".join(words)] if words else [])
    ones = np.zeros(64, int)
    for r in runs:
        h = xxhash.xxh64_intdigest(r.encode(), 42)
        ones += [(h >> b) & 1 for b in range(64)]
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(runs)) if runs else 0


@pytest.mark.parametrize(("radius", "hot"), [(2, 4096), (2, 1), (5, 3)])
def test_simhash(edge, spark, radius, hot):
    texts = edge_texts() + [(200 + i, prose(1, 120).replace("ka", "lo", i)) for i in range(8)]
    got = simhash_components(edge.sparkSession.createDataFrame(rows(texts), SCHEMA), radius=radius, hot=hot).collect()
    prints = [(i, fingerprint(t)) for i, t in texts]
    distinct = sorted({f for _, f in prints})
    root = {f: f for f in distinct}

    def top(f):
        while root[f] != f:
            f = root[f]
        return f

    for a in distinct:
        for b in distinct:
            if (a ^ b).bit_count() <= radius:
                root[top(a)] = top(b)
    least = {}
    for i, f in prints:
        if i is not None:
            least[top(f)] = min(i, least.get(top(f), i))
    want = collections.Counter((i, f, least.get(top(f))) for i, f in prints)
    assert collections.Counter((r.doc_id, r.fp % (1 << 64), r.component_id) for r in got) == want


def test_tree_and_components(spark):
    rng = np.random.default_rng(3)
    items = [int(x) for x in rng.integers(0, 1 << 16, 300)]
    tree = BKTree()
    for x in items:
        tree.add(x)
    for x in items[:40]:
        assert sorted(i for _, i in tree.within(x, 4)) == [i for i, y in enumerate(items) if (x ^ y).bit_count() <= 4]
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (102, 101), (7, 7), (60, 60), (None, 3)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 102: 100, 60: 60}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_fingerprints(edge, spark):
    def shingles(t):
        w = WORD.findall(t)
        return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    def alike(a, b):
        return len(a & b) / len(a | b) if a | b else 1.0

    texts = sorted({(i, t or "") for i, t in edge_texts()}, key=lambda x: (x[0] is not None, x[0] or 0))
    got = fingerprint_documents(edge, k=4096).collect()
    assert len(got) == len(edge_texts())
    by = {r.doc_id: r for r in got}
    for (i, t), (_, after) in zip(texts, texts[1:] + texts[:1]):
        r, half = by[i], len(t) // 2
        edited = t[:len(t) - half] + after[:half]
        assert (r.n_chars, r.edited) == (len(t), edited)
        if len(t) < 20_000:  # sketches of all shingles are exact
            assert r.near_edited == pytest.approx(alike(shingles(t), shingles(edited)))
            assert r.n_shingles == len(shingles(t))
    single = fingerprint_documents(spark.createDataFrame(rows([(1, prose(3, 9))]), SCHEMA)).collect()
    assert len(single) == 1 and single[0].near_next == 1.0
    assert by[5].fingerprint == by[1].fingerprint


def test_sketches_merge_and_estimate(spark):
    a, b = prose(11, 3000, 3000), prose(12, 2000, 3000)
    df = sketched(sketched(sketched(spark.createDataFrame([(a, b, a + " | | | | " + b)], "a string, b string, c string"), "a", "x"), "b", "y"), "c", "z")
    r = df.select(distinct_count(df.x).alias("n"), containment(df.x, df.z).alias("inside"), merged(df.x, df.y).alias("m"), "z").first()
    assert r.n == pytest.approx(2996, rel=0.3) and r.inside > 0.85
    assert len(set(r.m) & set(r.z)) > 110  # but for the few shingles across the joint


def test_empty_tables(empty):
    assert histogram_shards(empty).count() == 0
    assert pack_documents(empty, BYTE_BPE).count() == 0
    assert encode_decode(empty, WORD_BPE).count() == 0
    assert remove_repeats(empty).count() == 0
    assert simhash_components(empty).count() == 0
    assert fingerprint_documents(empty).count() == 0
