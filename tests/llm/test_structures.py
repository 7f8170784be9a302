"""Conversation repair, token block files and spelling variants against brute force."""

from __future__ import annotations

import hashlib
import itertools
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sparktick.llm import registry
from sparktick.llm.repair import TO_END, damaged, faults, keeps_to, repair_conversations, repair_report, search
from sparktick.llm.spelling import near_pairs, spelling_groups
from sparktick.llm.tokenblocks import Segment, pack, read_token_blocks, segment, token_blocks, unpack, write_token_blocks
from sparktick.session import scratch_path

from .conftest import SCHEMA, edge_texts, rows

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
GAP = " \t\n\x0b\x0c\r"


# --- conversations ---------------------------------------------------------------------------------------------------------------


def legal(initials: str) -> bool:
    rest = initials[1:] if initials.startswith("s") and len(initials) > 1 else initials
    return initials == "" or (len(rest) > 0 and len(rest) % 2 == 0 and rest == "ua" * (len(rest) // 2))


def all_repairs(roles, found):
    """Every audit with a cost up to that of deleting all rows, as (cost, audit, initials): plain enumeration."""
    def go(at, cost, audit, said, inserts):
        if cost > 4 * len(roles):  # deleting all rows is cheaper
            return
        if at == len(roles):
            yield cost, audit, said
        if inserts < 4:
            for role in "ua":
                yield from go(at, cost + 3, audit + "I", said + role, inserts + 1)
        if at < len(roles):
            yield from go(at + 1, cost + 4, audit + "D", said, 0)
            if found[at] not in ("b", "d"):
                more = 3 if found[at] == "t" else 0
                yield from go(at + 1, cost + more, audit + "K", said + (roles[at][:1] or "?"), 0)
                for role in "ua":
                    yield from go(at + 1, cost + 3 + more, audit + "R", said + role, 0)
    return go(0, 0, "", "", 0)


def test_search_finds_the_cheapest_and_least_audit():
    cases = [(r, f) for n in (0, 1, 2) for r in itertools.product("suat", repeat=n) for f in itertools.product(["", "t", "d"], repeat=n)]
    rng = random.Random(1)
    cases += [(rng.choices("suat", k=3), rng.choices(["", "", "t", "b"], k=3)) for _ in range(20)]
    for roles, found in cases:
        want = min((c, a) for c, a, said in all_repairs(roles, found) if legal(said))
        assert search(list(roles), list(found))[:2] == want, (roles, found)


def plain_repair(roles, found):
    """Dynamic programming from the last row, whole strings compared: for longer conversations."""
    best = [(TO_END[s], "I" * (TO_END[s] // 3)) for s in range(4)]
    onward = (2, 2, 3, 2)
    for role, fault in zip(reversed(roles), reversed(found)):
        edit = []
        for s in range(4):
            options = [(4 + best[s][0], "D" + best[s][1])]
            if fault not in ("b", "d"):
                more = 3 if fault == "t" else 0
                options.append((3 + more + best[onward[s]][0], "R" + best[onward[s]][1]))
                kept = keeps_to(s, role)
                if kept is not None:
                    options.append((more + best[kept][0], "K" + best[kept][1]))
            edit.append(min(options))
        once = [min(edit[s], (3 + edit[onward[s]][0], "I" + edit[onward[s]][1])) for s in range(4)]
        best = [min(edit[s], (3 + once[onward[s]][0], "I" + once[onward[s]][1])) for s in range(4)]
    return best[0]


def test_search_on_long_conversations_is_exact_and_linear():
    rng = random.Random(3)
    for n in (40, 300):
        for _ in range(30):
            roles = [rng.choice(["system", "user", "assistant", "user", "assistant", "x", ""]) for _ in range(n)]
            found = [rng.choice(["", "", "", "t", "d", "b"]) for _ in range(n)]
            assert search(roles, found)[:2] == plain_repair(roles, found)
    assert search(["system"] * 20_000, [""] * 20_000)[0] == 3 * 19_998 + 4  # one row is deleted, so that the rest make pairs


def brute_report(turns):
    """The contract read literally, one conversation after the other."""
    whole = {}
    for conv, turn, role, text in turns:
        whole.setdefault(conv, [])
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind == 0:
            continue
        role = "user" if kind == 4 else role
        text = "" if kind == 1 else "".join(c for c in text if c not in ".!?") if kind == 2 else text
        whole[conv] += [(turn, role, text)] * (2 if kind == 3 else 1)
    out = {}
    for conv, said in whole.items():
        said.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2]))
        found, seen = [], set()
        for _, role, text in said:
            inner = text.strip(GAP)
            found.append("b" if not inner else "d" if (role, text) in seen else "" if inner[-1] in ".!?" else "t")
            seen.add((role, text))
        numbers = [t for t, _, _ in said if t is not None]
        roles = [r for _, r, _ in said]
        cost, audit = plain_repair(roles, found)
        lines, at, state = [], 0, ""
        for edit in audit:
            wanted = "assistant" if state == "u" else "user"
            if edit == "I":
                lines.append(f"{wanted}:")
                state = wanted[0]
                continue
            if edit != "D":
                role = roles[at] if edit == "K" else wanted
                lines.append(f"{role}:{said[at][2]}")
                state = role[0]
            at += 1
        assert legal("".join(x[0] for x in lines))
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        illegal = sum(a[:1] + b[:1] not in ("su", "ua", "au") for a, b in zip(roles, roles[1:]))
        out[conv] = (
            gaps, found.count("b"), found.count("d"), found.count("t"), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest(),
        )
    return out


def odd_turns():
    rng = random.Random(5)
    texts = ["Yes.", "No!", "Perhaps", "", " \t", None, "Ümläut? ", "a\nb.", "x" * 5000 + " .  ", " " * 700]
    out = []
    for conv in [*range(60), None, -3, 1 << 40]:
        for turn in range(rng.choice([1, 1, 3, 8, 40])):
            out.append((conv, rng.choice([turn, turn, turn, None, turn * 3 - 5]), rng.choice(["user", "assistant", "system", "tool", "", None]), rng.choice(texts)))
    out += [(777, i // 2, ("user", "assistant")[i % 2], f"Line {i % 90}.") for i in range(1200)]  # a third of all rows
    return out + out[:25]  # repeated rows


@pytest.mark.parametrize("part_rows", [8192, 7])
def test_repair_report(spark, part_rows):
    turns = odd_turns()
    extra = "conv_id long, turn long, role string, text string, part int, seq int, present boolean, entry int, seen string, key string, n long"
    table = spark.createDataFrame([(*t, 1, 2, False, 3, "s", "k", 9) for t in turns], extra).repartition(5)
    got = {r.conv_id: tuple(r)[1:] for r in repair_report(*repair_conversations(damaged(table), part_rows)).collect()}
    assert got == brute_report(turns)
    edits = repair_conversations(damaged(table), part_rows)
    assert edits[0].unionByName(edits[1]).filter("size(edits) > 0").count() > 60


def test_faults_of_long_texts():
    assert faults(["user"] * 4, ["a." + " " * 10_000, "a" * 10_000, " " * 10_000, "a" * 10_000], set()) == ["", "t", "b", "d"]


def test_no_conversations(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert repair_report(*repair_conversations(damaged(none))).count() == 0


def test_conversation_query(spark, sf):
    turns = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = {r.conv_id: tuple(r)[1:] for r in registry.op11_conversation_repair(spark, sf).collect()}
    assert got == brute_report(turns)


# --- token blocks ----------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("n", [0, 1, 255, 256, 257, 5000])
@pytest.mark.parametrize("percentile", [1, 50, 90, 100])
def test_packed_blocks_round_trip(n, percentile):
    rng = np.random.default_rng(n)
    for ids in (rng.integers(0, 49_408, n), rng.integers(0, 3, n), np.full(n, 7), rng.integers(0, 1 << 32, n), np.where(rng.random(n) < 0.02, 1 << 31, rng.integers(90, 99, n))):
        ids = ids.astype(np.uint32)
        parts = pack(ids, percentile)
        blocks = np.arange(len(parts["low"]))
        assert (unpack(parts, blocks)[:n] == ids).all()
        if len(blocks) > 3:
            chosen = np.array([3, 1])
            assert (unpack(parts, chosen) == np.concatenate([ids[3 * 256:4 * 256], ids[256:512]])).all()


def test_outliers_do_not_widen_blocks():
    ids = np.full(2560, 100, np.uint32)
    ids[::37] = 1 << 20
    parts = pack(ids)
    assert (parts["width"] == 0).all() and len(parts["place"]) == len(ids[::37]) and len(parts["packed"]) == 0


def test_segment_slices():
    ids = np.random.default_rng(1).integers(0, 49_408, 10_000).astype(np.uint32)
    s = Segment(memoryview(segment(3, 5, [4, None, -1], [1000, 0, 9000], ids)))
    assert (s.task, s.number, s.doc_ids, s.n_ids) == (3, 5, [4, None, -1], 10_000)
    for a, b in ((0, None), (0, 1), (255, 257), (9_999, 10_000), (5_000, 99_999), (70, 70)):
        assert (s.ids(a, b) == ids[a:b]).all()


def library_rows(texts):
    library = Tokenizer.from_file(WORD_BPE)
    out, start = [], 0
    for i, t in sorted(texts, key=lambda x: (x[0] is not None, x[0] or 0)):
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 1], "<u4").tobytes()
        out.append((i, start, len(ids) // 4, zlib.crc32(ids)))
        start += len(ids) // 4
    return out


def test_token_blocks(spark, edge):
    want = library_rows(edge_texts())
    got = token_blocks(edge, WORD_BPE, with_ids=True).collect()
    assert sorted((-1 << 60 if r.doc_id is None else r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in got) == sorted((-1 << 60 if r[0] is None else r[0], *r[1:]) for r in want)
    assert all(zlib.crc32(r.ids) == r.ids_crc32 for r in got)


def test_token_blocks_in_many_segments_and_files(spark, edge):
    path = scratch_path(spark, "test-blocks")
    write_token_blocks(edge, WORD_BPE, path, segment_ids=40)
    assert spark.read.format("binaryFile").load(path).count() >= 4
    got = read_token_blocks(spark, path).orderBy("start").collect()
    assert [(r.start, r.n_tokens, r.ids_crc32) for r in got] == [r[1:] for r in library_rows(edge_texts())]


def test_no_documents_no_blocks(spark, empty):
    assert token_blocks(empty, WORD_BPE).count() == 0


def test_token_block_query(spark, sf):
    texts = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = sorted(tuple(r) for r in registry.op12_token_blocks(spark, sf).collect())
    assert got == library_rows(texts)


# --- spelling --------------------------------------------------------------------------------------------------------------------


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    k = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[k + 1:] == b[k + 1:] if len(a) == len(b) else a[k:] == b[k + 1:]


def brute_groups(texts, shortest=7, least=2):
    counts = Counter()
    for i, t in texts:
        run = ""
        for c in (t or "") + " ":
            if c.isascii() and c.isalpha() or "À" <= c <= "ÿ":
                run += c.lower() if c.isascii() else c
                continue
            if run:
                h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
                at = h % len(run)
                counts[run[:at] + run[at + 1:] if h % 31 == 0 else run] += 1
            run = ""
    counts = {w: n for w, n in counts.items() if len(w) >= shortest and n >= least}
    near = {w: [v for v in counts if one_edit(w, v)] for w in counts}
    form = {}
    for w, n in counts.items():
        best = min(near[w], key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= 10 * n else None
    out = {}
    for w, n in counts.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (form[w], root, n, len(near[w]), counts[form[w]] if form[w] else None)
    return out


def word_texts():
    rng = random.Random(11)
    alphabet = "abcdeéöÿÀ"
    bases = ["".join(rng.choice(alphabet) for _ in range(rng.randint(7, 12))) for _ in range(25)] + ["preface" + "z" * 60, "aaaaaaaa", "hauptwort"]
    texts = []
    for i in range(300):
        words = []
        for _ in range(40):
            w = rng.choice(bases)
            if rng.random() < 0.12:
                at = rng.randrange(len(w) + 1)
                w = rng.choice([w[:at] + rng.choice(alphabet) + w[at:], w[:at] + w[at + 1:], w[:at] + rng.choice(alphabet) + w[at + 1:]])
            words.append(w.upper() if rng.random() < 0.1 else w)
        texts.append((i, rng.choice([" ", "-", "1", "\n", "×ß. "]).join(words)))
    # counts of 2, 25, 300: a chain of forms; many words with one half in common
    texts += [(1000 + i, "chainsaw" if i >= 27 else "chainsow" if i >= 2 else "chainsowe") for i in range(330)]
    texts += [(2000 + i, " ".join(["gemeinsam" + a + b for a in "abcdefgh" for b in "stuvwxyzé"])) for i in range(2)]
    return texts + edge_texts() + [(3, None), (None, "namenlos namenlos"), (6, "y" * 50_000 + " " + "y" * 50_000 + " " + "y" * 50_001), (6, "y" * 50_001)]


@pytest.mark.parametrize("most_pairs", [1024, 4])
def test_spelling_groups(spark, most_pairs):
    texts = word_texts()
    got = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in spelling_groups(spark.createDataFrame(rows(texts), SCHEMA).repartition(4), most_pairs=most_pairs).collect()}
    want = brute_groups(texts)
    assert {w: want.get(w) for w in got} == got and got.keys() == want.keys()
    assert got["chainsowe"][:2] == ("chainsow", "chainsaw") and sum(v[0] is not None for v in got.values()) > 50


def test_hot_chunk_makes_few_candidates(spark):
    """4,000 words share their first half: split buckets verify few candidates, all pairs are found."""
    rng = random.Random(2)
    words = sorted({"gleichan" + "".join(rng.choice("abcdefghij") for _ in range(7)) for _ in range(4000)})
    table = spark.createDataFrame([(w, 2, len(w)) for w in words], "word string, n long, len int")
    known = set(words)
    want = {(w, v) for w in words for i in range(8, 15) for c in "abcdefghij" if (v := w[:i] + c + w[i + 1:]) in known and w < v}
    got = [(r.a, r.b) for r in near_pairs(table).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_no_words(spark, empty):
    assert spelling_groups(empty).count() == 0


def test_spelling_query(spark, sf):
    texts = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in registry.op13_spelling_groups(spark, sf).collect()}
    counts = spark.createDataFrame([(w,) for w in got], "word string").filter(F.length("word") < 7).count()
    want = brute_groups(texts, least=2) if len(got) < 6000 else got
    assert counts == 0 and got == want


def test_words_are_encoded_as_by_the_library():
    import pyarrow as pa

    from sparktick.llm.tokenblocks import WordIds

    rng = random.Random(1)
    signs = "aAbZ.,;:!?'’ \n\t1²ÄäÖß<|>éÉ́̌ -_/\\sStTrReE"
    texts = ["J̌ust H̱ello T̈.", "a.b,c!d...e", "don't.it's'S", "<|STARTOFTEXT|> x.y <|endoftext|>z", "İSTANBUL Σς ΑΣ. x", "日本語.abc. Привет!", "", "'re'll 'D"]
    texts += ["".join(rng.choice(signs) for _ in range(rng.randint(1, 60))) for _ in range(400)]
    words = WordIds(WORD_BPE)
    for some in (texts, texts[:3], texts[8:]):
        for text, ids in zip(some, words.encode(pa.array(some))):
            assert np.frombuffer(bytes(ids), "<u4").tolist() == words.library.encode(text, add_special_tokens=False).ids, text
