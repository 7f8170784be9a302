"""Search, chat trees, classifiers, near copies and the pipeline against brute-force versions."""

from __future__ import annotations

import collections
import math
import random

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from sparktick.llm.chat import chat_trees, escape, formatted_turn, parsed, read_back, unescape
from sparktick.llm.neardup import drop_near_duplicates, near_duplicate_groups
from sparktick.llm.neighbours import nearest, perturbations
from sparktick.llm.quality import BITS, gram_scores, quality
from sparktick.llm.toxicity import CharModel, Detector, arcs, restore, skeletons, toxicity, word_starts

from .conftest import SCHEMA, edge_texts, prose, rows


# ---- nearest neighbours ---------------------------------------------------------------------------------------------------------


def vectors(spark, clustered=False):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 8)) if not clustered else rng.normal(size=(6, 8)).repeat(50, axis=0) + 0.05 * rng.normal(size=(300, 8))
    data = [(i, [float(v) for v in row], "e") for i, row in enumerate(x)]
    data += [(1000 + i, data[4][1], "copy") for i in range(40)] + [(4, data[4][1], "again")]
    data += [(2000, None, "x"), (2020, [0.0] * 8, "x"), (2040, [float("nan")] + [1.0] * 7, "x"), (2060, [1.0] * 7 + [float("inf")], "x"),
             (2080, [None] + [1.0] * 7, "x"), (2100, [1.0] * 3, "x"), (None, [1.0] * 8, "x")]
    return spark.createDataFrame(data, "vec_id long, embedding array<double>, query string"), {i: v for i, v, _ in data[:340]}


def inner(a, b):
    total = 0.0  # in this order, without the compensation of sum()
    for x, y in zip(a, b):
        total += x * y
    return total


@pytest.mark.parametrize(("projections", "bucket"), [(0, 8192), (0, 16), (2, 16), (None, 8192)])
def test_nearest(spark, projections, bucket):
    df, known = vectors(spark)
    got = nearest(df, F.col("vec_id") % 20 == 0, k=20, projections=projections, bucket=bucket).collect()
    by = collections.defaultdict(list)
    for r in sorted(got, key=lambda r: (r.query_id, r["rank"])):
        by[r.query_id].append((r.vec_id, r.score))
    assert set(by) == {i for i in known if i % 20 == 0}
    hits = 0
    for q, found in by.items():
        score = {i: inner(known[q], v) for i, v in known.items() if i != q}
        want = sorted(score, key=lambda i: (-score[i], i))[:20]
        assert len(found) == 20 and all(s == score[i] for i, s in found)
        assert [i for i, _ in found] == sorted((i for i, _ in found), key=lambda i: (-score[i], i))
        hits += len(set(want) & {i for i, _ in found})
        if projections == 0:
            assert [i for i, _ in found] == want
    assert hits >= 0.9 * 20 * len(by)


def test_nearest_candidates_grow_with_the_queries(spark, monkeypatch):
    """However many parts the index has, a search of all buckets finds the nearest, and few candidates of each query are returned."""
    import sparktick.llm.neighbours as N

    rng = np.random.default_rng(5)
    vectors = rng.normal(size=(800, 8))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    returned, labels, keep = [], [], N.materialise

    def counted(rows, label):
        out = keep(rows, label)
        labels.append(label)
        if label == "ann-candidates":
            returned.append(out.count())
        return out

    monkeypatch.setattr(N, "materialise", counted)
    monkeypatch.setattr(N, "PART", 50)
    got = N.nearest(df, F.col("vec_id") % 20 == 0, k=5, projections=0).collect()
    scores = vectors @ vectors.T
    for q in range(0, 800, 20):
        order = [v for v in np.lexsort((np.arange(800), -scores[q])) if v != q][:5]
        assert [r.vec_id for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == q] == order
    assert len(returned) == 3 and max(returned) <= 40 * (5 + 1 + N.SPARE)  # rounds of 4, 4 and 8 parts of 50 vectors


def test_nearest_of_few(spark):
    few = spark.createDataFrame([(20, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [3.0, 0.0])], "vec_id long, embedding array<double>")
    got = nearest(few, F.col("vec_id") == 20, k=20).collect()
    assert sorted((r["rank"], r.vec_id, r.score) for r in got) == [(1, 2, 3.0), (2, 1, 0.5)]
    assert nearest(few.limit(0), F.lit(True)).count() == 0


def test_probe_order():
    moves = perturbations(np.array([0.1, 0.45]), 9)
    cost = [sum((0.1, 0.45)[j] ** 2 if s < 0 else (0.9, 0.55)[j] ** 2 for j, s in enumerate(m) if s) for m in moves]
    assert moves[0] == [0, 0] and moves[1] == [-1, 0] and cost == sorted(cost) and len({tuple(m) for m in moves}) == 9


# ---- chat -----------------------------------------------------------------------------------------------------------------------


@given(st.text(alphabet="\\<>/s[]INTSY|atr_urn ", max_size=40))
def test_escape(text):
    assert unescape(escape(text)) == text
    value, a, b = formatted_turn("user", text)
    assert parsed(value + value) == [("user", text)] * 2 and unescape(value[a:b]) == text
    assert not any(c in escape(text) for c in ("</s>", "[INST]", "[/INST]", "<|turn|>", "<|text|>"))


def test_chat(spark):
    control = "</s>[INST] ok [/INST]\\ <|turn|>"
    data = [(-1, 0, "user", control), (-1, 1, "assistant", control), (5, None, None, None), (6, 0, "user", ""), (6, 0, "user", ""), (None, 0, "user", "x")]
    for c in range(30):
        for t in range(5):
            data.append((10 + c, t, ("user", "assistant")[t % 2], f"turn {t} {c % 3 if t > 2 else 0} é\U0001f600"))
    df = spark.createDataFrame([(*r, 1, "p", 2) for r in data], "conv_id long, turn long, role string, text string, block long, path string, node long")
    nodes = chat_trees(df)
    got = {r.conv_id: r for r in read_back(nodes).collect()}
    want = collections.defaultdict(list)
    for c, t, role, text in data:
        if c is not None:
            want[c].append((-1 if t is None else t, role or "", text or ""))
    assert set(got) == set(want)
    for c, turns in want.items():
        turns.sort()
        assert [(t.role, t.text) for t in got[c].turns] == [t[1:] for t in turns]
        assert got[c].loss == "".join(t[2] for t in turns if t[1] == "assistant")
    tree = nodes.collect()
    assert sum(n.length for n in tree) < 0.5 * sum(len(r.formatted) for r in got.values())  # shared turns stand there once
    for block in {n.block for n in tree}:
        own = sorted((n for n in tree if n.block == block), key=lambda n: n.node)
        at = 0
        for n in own:
            assert n.start == at and (n.parent < n.node)
            seen = sum(s.end - s.start for s in n.attends)
            assert seen == n.position and all(s.end <= n.start for s in n.attends)
            at += n.length
    assert chat_trees(df.limit(0)).count() == 0 and read_back(chat_trees(df.limit(0))).count() == 0


# ---- toxicity -------------------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def model():
    from sparktick.llm.toxicity import _trigrams
    import pyarrow as pa

    text = " ".join([prose(1, 4000), "you are a moron and an idiot with stupid worthless trash scum tell the moon"] * 3)
    batch = next(_trigrams(iter([pa.RecordBatch.from_arrays([pa.array([text])], names=["text"])])))
    return CharModel(dict(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())))


@pytest.mark.parametrize(("token", "meant"), [
    ("m0r0n", "moron"), ("1d10t", "idiot"), ("stuuuupid", "stupid"), ("$cum", "scum"), ("i.d.i.o.t", "idiot"), ("tr@sh!", "trash"),
    ("w0rthless", "worthless"), ("moon", "moon"), ("MORON", "moron"), ("2024", "2024"),
])
def test_restore(model, token, meant):
    assert restore(token, model) == meant


def test_viterbi_is_the_best_path(model):
    def cost(text):
        a = b = total = 0
        from sparktick.llm.toxicity import CODE
        for c in [*text, None]:
            code = int(CODE[ord(c)]) if c else 0
            total, a, b = total + model.step(a, b, code), b, code
        return total

    for token in ("m0r0nn", "t3ll1t", "$t00p!d"):
        paths = [("", 0.0)]
        for _, options in arcs(token):
            paths = [(t + x, p + q) for t, p in paths for x, q in options]
        assert restore(token, model) == min((p + cost(t), t) for t, p in paths)[1]
        assert any(s in skeletons(token) for s in skeletons(restore(token, model)))


def test_toxicity(spark, model, empty):
    rng = random.Random(2)
    bad = ["idiot", "scum", "1d1ot", "s c u m", "id.iot"]
    docs, labels = [], []
    for i in range(400):
        words = prose(1000 + i, 40).split()
        toxic = i % 4 == 0
        if toxic:
            words.insert(rng.randrange(40), bad[i // 4 % 5] if i > 200 else bad[i // 4 % 2])
        docs.append((i, " ".join(words)))
        if i % 3:
            labels.append((i, 1, int(toxic)))
    docs += [(900, None), (901, ""), (None, "an idiot"), (902, prose(5, 3000) + " scum"), (900, None)]
    labels += [(None, 1, 1), (900, None, None), (5, 0, 0), (5, 1, 1)]
    got = toxicity(
        spark.createDataFrame(rows(docs), SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), carried=("lang", "id"),
    ).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == 405 and all(0 <= r.score <= 1 for r in got)
    wrong = [i for i in range(400) if by[i].predicted != (i % 4 == 0)]
    assert len(wrong) <= 12
    assert by[900].predicted == by[901].predicted == 0 and by[None].predicted == 1 and by[902].predicted == 1 and not by[None].held_out
    assert toxicity(empty, spark.createDataFrame([], "doc_id long, quality int, toxic int")).count() == 0
    none = toxicity(spark.createDataFrame(rows(docs[:3]), SCHEMA), spark.createDataFrame([], "doc_id long, quality int, toxic int")).collect()
    assert [r.score for r in none] == [0.0] * 3


def test_spaced_words_and_counts(model):
    d = Detector({"scum ": (0.9, 0.9, 0.9), "réeux": (0.1, 0.5, 0.9)}, model)
    assert d.uses("a s c u m. and scum, SCUM!") == {"scum ": 3}
    assert d.uses("réeuxa réeuxb éréeux") == {"réeux": 2} and d.score({"réeux": 1}) == pytest.approx(0.1)


def test_spaced_beginnings(model):
    d = Detector({"réeux": (0.1, 0.5, 0.9), "worthl": (0.9, 0.9, 0.9), "moron ": (0.9, 0.9, 0.9)}, model)
    assert d.uses("un r é e u x a là, r é e u x.") == {"réeux": 2}  # at the start of a run
    assert d.uses("tell y o u a r e w o r t h l e s s") == {"worthl": 1} == d.uses("y 0 u w 0 r t h 1 e s s!")  # where a word begins
    assert d.uses("w o r t h l e s s m o r o n") == {"worthl": 1, "moron ": 1}
    assert d.uses("r-r é-é-é u") == {} == d.uses("a b c d e f")
    assert word_starts("youareworthless", model) == [0, 3, 6]


# ---- quality --------------------------------------------------------------------------------------------------------------------


def test_kneser_ney_sums_to_one_and_equals_brute_force(spark):
    text = "abracadabra abba cad dab a bad cab"
    order = 3
    padded = "\x01" * (order - 1) + text
    counts = collections.Counter(padded[i:i + order] for i in range(len(text)))

    def code(g):
        out = 0
        for c in g:
            out = (out << BITS) | ord(c)
        return out

    alphabet = sorted(set(text))
    every = {h + c for h in {g[:-1] for g in counts} | {"zz"} for c in alphabet}
    table = [("en", code(g), counts.get(g, 0)) for g in every | set(counts)]
    got = {r.gram: math.exp(-r.cost) for r in gram_scores(spark.createDataFrame(table, "lang string, gram long, n long"), order).collect()}
    for h in {g[:-1] for g in counts} | {"zz"}:
        # The unseen characters of the uniform order hold what is missing.
        assert 0.9 < sum(got[code(h + c)] for c in alphabet) <= 1.0 + 1e-6
    levels = {3: counts}
    for n in (2, 1):
        levels[n] = collections.Counter(g[1:] for g in levels[n + 1])

    def probability(g):
        if not g:
            return 1 / (len(levels[1]) + 1)
        c = levels[len(g)]
        k = [sum(v == i for v in c.values()) for i in (1, 2, 3, 4)]
        y = k[0] / max(k[0] + 2 * k[1], 1)
        d = [0.5 if k[i] == 0 or y == 0 else min(max(i + 1 - (i + 2) * y * k[i + 1] / k[i], 0.1), i + 0.9) for i in range(3)]
        own = {x: v for x, v in c.items() if x[:-1] == g[:-1]}
        if not own:
            return probability(g[1:])
        total = sum(own.values())
        cut = lambda v: d[min(v, 3) - 1]
        return max(0, own.get(g, 0) - cut(own[g])) / total * (g in own) + sum(map(cut, own.values())) / total * probability(g[1:]) if g in own else (
            sum(map(cut, own.values())) / total * probability(g[1:]))

    assert all(got[code(g)] == pytest.approx(probability(g), rel=1e-4) for g in every)


def test_quality(spark, empty):
    docs = [(i, prose(i, 80)) for i in range(200)] + [(300 + i, " ".join(w.upper() + "!!" for w in prose(i, 80).split())) for i in range(20)]
    docs += [(400, None), (401, " "), (None, prose(77, 50)), (3, prose(3, 80)), (500, prose(8, 20_000))]
    labels = [(i, 1 if i < 200 else 0, 0) for i in range(0, 320, 2)] + [(None, 1, 0), (5, 0, 0), (5, 1, 0), (7, None, None)]
    table = spark.createDataFrame(rows(docs), SCHEMA).withColumn("lang", F.when(F.col("doc_id") == 9, None).otherwise("en"))
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    results = [quality(table, marks, **kw).collect() for kw in ({}, {"shard_size": 60, "known_ids": 0})]
    for got in results:
        keep = {r.doc_id: r.keep for r in got}
        assert len({(r.doc_id, r.h) for r in got}) == len(got) == len(set(docs))
        assert sum(not keep[i] for i in range(200)) <= 6 and keep[None] and keep[500] and keep[9]
        assert not any(keep[300 + i] for i in range(20)) and not keep[400]
    a, b = ({(r.doc_id, r.h): r.perplexity for r in got} for got in results)
    assert all(a[k] == b[k] or a[k] == pytest.approx(b[k]) for k in a)
    assert quality(empty, marks).count() == 0
    assert all(r.keep for r in quality(table.filter("doc_id < 3"), marks.limit(0)).collect())


# ---- near copies and pipeline ---------------------------------------------------------------------------------------------------


def near_groups(texts, width=5, similarity=0.8):
    sets = []
    for i, t in texts:
        w = (t or "").split()
        sets.append((i, frozenset(" ".join(w[k:k + width]) for k in range(max(1, len(w) - width + 1))) if w else frozenset()))
    root = list(range(len(sets)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if len(x & y) >= similarity * len(x | y):
                root[top(a)] = top(b)
    least = {}
    for k, (i, _) in enumerate(sets):
        if i is not None:
            least[top(k)] = min(i, least.get(top(k), i))
    return collections.Counter((sets[k][0], least.get(top(k))) for k in range(len(sets)))


def near_texts():
    texts = list(edge_texts())
    for i in range(60):
        words = prose(500 + i // 12, 150).split()
        rng = random.Random(i)
        for _ in range(i % 4):
            words[rng.randrange(150)] = "edit" + str(i)
        texts.append((600 + i, " ".join(words)))
    return texts


@pytest.mark.parametrize("few", [3, 1])
def test_near_copies(spark, few, monkeypatch):
    monkeypatch.setattr("sparktick.llm.neardup.FEW", few)
    texts = near_texts()
    got = near_duplicate_groups(spark.createDataFrame(rows(texts), SCHEMA)).collect()
    assert collections.Counter((r.doc_id, r.group) for r in got) == near_groups(texts)


def test_drop_near_copies(spark, empty):
    texts = near_texts()
    df = spark.createDataFrame(rows(texts), SCHEMA)
    got = drop_near_duplicates(df)
    assert got.columns == df.columns
    want = {g for _, g in near_groups(texts)}
    assert sorted((r.doc_id is not None, r.doc_id or 0) for r in got.collect()) == sorted((g is not None, g or 0) for g in want)
    assert drop_near_duplicates(empty).count() == 0


@pytest.mark.parametrize(("few", "block", "work"), [(3, 512, 64), (1, 4, 0)])
def test_near_copies_at_the_bound_are_all_found(spark, monkeypatch, few, block, work):
    """Pairs just at the similarity, of short and long texts, in families, and with a line that all texts share."""
    for name, value in (("FEW", few), ("HOT_BLOCK", block), ("WORK", work)):
        monkeypatch.setattr(f"sparktick.llm.neardup.{name}", value)
    rng, texts, line = random.Random(4), [], "all of these texts share this one line of words "
    for k in range(150):  # 4 of 5 shingles shared
        words = [f"s{k}w{i}" for i in range(8)]
        texts += [(10 * k, " ".join(words)), (10 * k + 1, " ".join([*words, f"end{k}"]))]
    for k in range(100):  # 40 and 50 shingles
        words = [f"t{k}w{i}" for i in range(54)]
        texts += [(10_000 + 10 * k, " ".join(words[:44])), (10_001 + 10 * k, " ".join(words))]
    for k in range(80):  # a family, each with two edits
        words = [f"f{i}" for i in range(80)]
        for _ in range(2):
            words[rng.randrange(80)] = f"e{rng.random()}"
        texts.append((20_000 + k, line + " ".join(words)))
    texts += [(30_000 + k, line + prose(900 + k, 30)) for k in range(40)]
    got = near_duplicate_groups(spark.createDataFrame(rows(texts), SCHEMA)).collect()
    assert collections.Counter((r.doc_id, r.group) for r in got) == near_groups(texts)


def test_near_copies_go_by_fingerprints_first(spark, sf, monkeypatch):
    """The stage gets its rows through operator 6: with the exact join left out, documents of one component are gone all the same."""
    words = prose(21, 300, 4000).split()
    texts = [(7, " ".join(words)), (3, " ".join(words).upper()), (8, prose(22, 80)), (12, prose(23, 80)), (8, prose(22, 80)), (None, prose(24, 50)), (None, ""), (9, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in texts], "doc_id long, text string, lang string, source string, n_chars long")
    named = lambda rows: sorted((str(i), t or "") for i, t in rows)
    once = [texts[k] for k in (1, 2, 3, 5, 7)]
    assert named((r.doc_id, r.text) for r in corpus_pipeline.drop_copies(spark, docs, sf).collect()) == named(once)
    monkeypatch.setattr(corpus_pipeline, "drop_near_duplicates", lambda rows: rows)
    assert named((r.doc_id, r.text) for r in corpus_pipeline.drop_copies(spark, docs, sf).collect()) == named([*once, texts[4]])


def test_pipeline(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    before = {r.doc_id: r for r in docs.collect()}
    labels = {r.doc_id: r for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, sf).collect(), docs.select(*corpus_pipeline.COLUMNS).schema)
        kept = {r.doc_id: r for r in docs.collect()}
        assert set(kept) <= set(before) and docs.columns == corpus_pipeline.COLUMNS
        if name != "passages":
            assert all(kept[i].text == before[i].text for i in kept)
        if name == "quality":
            clean = [i for i in before if i in labels and labels[i].quality == 1]
            assert sum(i not in kept for i in clean) <= 0.05 * len(clean)
        if name == "near copies":
            assert set(kept) == {g for _, g in near_groups([(i, r.text) for i, r in before.items()])}
        before = kept
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, sf).collect()
    assert {r.doc_id for r in pieces} == set(before)
    fill = collections.Counter()
    for r in pieces:
        fill[r.sequence_id] += r.length
    assert max(fill.values()) <= 2048
