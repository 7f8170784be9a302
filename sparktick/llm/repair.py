"""Repair of conversation structure: cheapest edits by depth-first branch and bound, long conversations in linked parts."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparktick.llm.common import released
from sparktick.session import materialise

# Fixed values of the task: costs, and the white space and sentence ends that faults are judged by.
DELETE, REROLE, INSERT, TRUNCATED = 4, 3, 3, 3
VISIBLE = re.compile(r"[^\x20\x09-\x0D]")
LAST_VISIBLE = re.compile(r"[^\x20\x09-\x0D](?=[\x20\x09-\x0D]*\Z)")
LEGAL_PAIRS = ("su", "ua", "au")
# What has been said so far: nothing, a system turn, a user turn, an assistant turn. Repaired roles are (s?(ua)+)?.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
STATES = range(4)
NEXT = (USER, USER, ASSISTANT, USER)  # the only state an inserted or re-roled turn may lead to
TO_END = (0, 2 * INSERT, INSERT, 0)  # cheapest inserts after the last row
FAR = 1 << 60
# A part of a conversation has at most so many rows, and so many characters besides its last row.
PART_ROWS, PART_CHARS = 8192, 4 << 20
PART = "conv_id long, part int, seq int, present boolean, turns array<long>, roles array<string>, texts array<string>"


def damaged(rows: DataFrame) -> DataFrame:
    """Rows with reproducible faults, by crc32 of "conv_id:turn" modulo 20; nulls are one space there, in roles and in texts.

    Returns conv_id, turn, role, text and `present`, which is false for dropped rows (kept as a sign that the conversation exists).
    """
    blank = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), blank), F.lit(":"), F.coalesce(F.col("turn").cast("string"), blank))
    role, text = (F.coalesce(F.col(c).cast("string"), blank) for c in ("role", "text"))
    kind = F.crc32(key) % 20
    return rows.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.when(kind == 4, "user").otherwise(role).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        (kind != 0).alias("present"), F.explode(F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("_copy"),
    ).drop("_copy")


def conversation_parts(rows: DataFrame, part_rows: int = PART_ROWS, part_chars: int = PART_CHARS) -> DataFrame:
    """Conversations in the order of their turns, as parts of bounded size, written once.

    The rows are dealt by ranges of their order, so a conversation of any length is spread over tasks, and a part is cut from one
    task's rows. (part, seq) orders the parts of a conversation. Rows of one turn are ordered by role, then text.
    """
    keys = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role")]
    dealt = rows.repartitionByRange(*keys, F.substring("text", 1, 64)).sortWithinPartitions(*keys, "text")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        held: list[tuple] = []
        at = chars = seq = 0
        key, turns, roles, texts, rows_seen = None, [], [], [], False

        def close() -> None:
            nonlocal turns, roles, texts, at, seq, rows_seen
            held.append((key, task, seq, bool(turns), turns, roles, texts))
            turns, roles, texts, at, rows_seen = [], [], [], 0, False
            seq += 1

        for batch in batches:
            for conv, turn, role, text, present in zip(*(c.to_pylist() for c in batch.columns)):
                if rows_seen and (conv != key or len(turns) >= part_rows or at >= part_chars):
                    close()
                key, rows_seen = conv, True
                if present:
                    turns.append(turn), roles.append(role), texts.append(text)
                    at += len(text)
                    chars += len(text)
                if chars >= 4 * PART_CHARS or len(held) >= 4096:
                    if held:
                        yield _batch(held, PART_FIELDS)
                    held, chars = [], 0
        if rows_seen:
            close()
        if held:
            yield _batch(held, PART_FIELDS)

    return materialise(dealt.mapInArrow(released(cut), PART), "conversation-parts")


PART_FIELDS = pa.schema([
    ("conv_id", pa.int64()), ("part", pa.int32()), ("seq", pa.int32()), ("present", pa.bool_()), ("turns", pa.list_(pa.int64())),
    ("roles", pa.list_(pa.string())), ("texts", pa.list_(pa.string())),
])


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


# --- the search ------------------------------------------------------------------------------------------------------------------


def faults(roles: list[str], texts: list[str], seen: set[bytes]) -> list[str]:
    """The first fault of each row: "b" blank, "d" said before with that role, "t" truncated, "" none. `seen` gets the rows' keys."""
    out = []
    for role, text in zip(roles, texts):
        key = row_key(role, text)
        last = LAST_VISIBLE.search(text) if len(text) < 200 else _last_visible(text)
        out.append("b" if last is None else "d" if key in seen else "" if last[0] in ".!?" else "t")
        seen.add(key)
    return out


def _last_visible(text: str) -> re.Match | None:
    """As LAST_VISIBLE, from the end of a long text."""
    for start in range(len(text) - 100, -100, -100):
        found = LAST_VISIBLE.search(text, max(0, start))
        if found:
            return found
    return None


def row_key(role: str, text: str) -> bytes:
    return hashlib.md5(f"{len(role)}:{role}{text}".encode()).digest()


def keeps_to(state: int, role: str) -> int | None:
    """State after a row is kept with its role; None if it may not follow."""
    initial = role[:1]
    if initial == "s":
        return SYSTEM if state == NOTHING else None
    wanted = {"u": USER, "a": ASSISTANT}.get(initial)
    return wanted if wanted is not None and NEXT[state] == wanted else None


def suffix_bounds(roles: list[str], found: list[str], finish) -> list[tuple[int, ...]]:
    """For each row and state, the least cost of what is still to come if the order of equally cheap edits is left open.

    `finish[state]` is the cost after the last row. Nothing cheaper is possible, so a prefix whose cost plus this bound exceeds
    the incumbent's cost cannot be part of a better repair.
    """
    bounds = [tuple(finish)]
    for role, fault in zip(reversed(roles), reversed(found)):
        after = bounds[-1]
        more = TRUNCATED if fault == "t" else 0
        edit = []
        for state in STATES:
            least = DELETE + after[state]
            if fault not in ("b", "d"):
                kept = keeps_to(state, role)
                if kept is not None:
                    least = min(least, more + after[kept])
                least = min(least, REROLE + more + after[NEXT[state]])
            edit.append(least)
        once = [min(edit[s], INSERT + edit[NEXT[s]]) for s in STATES]
        bounds.append(tuple(min(edit[s], INSERT + once[NEXT[s]]) for s in STATES))
    return bounds[::-1]


def search(roles: list[str], found: list[str], entry: int = NOTHING, finish=TO_END, last: bool = True) -> tuple[int, str, int]:
    """(cost, audit, state after the last row) of the cheapest repair, of the ASCII-least audit among equally cheap ones.

    Depth first with an explicit stack; of a row's edits the one with the least cost and suffix bound comes first, of equal ones
    the ASCII-least (Delete, Insert, Keep, Rerole). The incumbent starts as "delete everything", the ASCII-least audit of its cost.
    A prefix goes if its cost plus the suffix bound does not beat the incumbent, or if its node (row, state) was reached before at no
    higher cost: of two prefixes of one node and cost the earlier is ASCII-less, and neither begins with the other (they took
    equally many rows, and more inserts cost more). With `last`, inserts may follow the last row.
    """
    n = len(roles)
    bounds = suffix_bounds(roles, found, finish)
    trailing = TO_END[entry] // INSERT if last else 0
    best = (DELETE * n + finish[entry], "D" * n + "I" * trailing, entry)
    table = [[FAR] * 4 for _ in range(n + 1)]
    path = bytearray()
    stack = [(0, entry, 0, 0, 0)]  # row, state, cost, length of the path before the last letter, last letter
    while stack:
        at, state, cost, depth, letter = stack.pop()
        if cost + bounds[at][state] >= best[0] or cost >= table[at][state]:
            continue
        table[at][state] = cost
        if letter:
            del path[depth:]
            path.append(letter)
            depth += 1
        if at == n:
            if not last or TO_END[state] == 0:
                best = (cost + (0 if last else finish[state]), path[:depth].decode(), state)
            else:
                stack.append((at, NEXT[state], cost + INSERT, depth, ord("I")))
            continue
        role, fault = roles[at], found[at]
        onward = [(at + 1, state, cost + DELETE, depth, ord("D")), (at, NEXT[state], cost + INSERT, depth, ord("I"))]
        if fault not in ("b", "d"):
            more = TRUNCATED if fault == "t" else 0
            kept = keeps_to(state, role)
            if kept is not None:
                onward.append((at + 1, kept, cost + more, depth, ord("K")))
            onward.append((at + 1, NEXT[state], cost + REROLE + more, depth, ord("R")))
        onward.sort(key=lambda x: (x[2] + bounds[x[0]][x[1]], x[4]), reverse=True)
        stack.extend(onward)
    return best


def applied(audit: str, roles: list[str], texts: list[str], entry: int = NOTHING) -> list[tuple[str, str, str]]:
    """(edit, role, text) of each edit; deleted rows keep their own role and text, but are not part of the repaired conversation."""
    state, at, out = entry, 0, []
    for edit in audit:
        wanted = "user" if NEXT[state] == USER else "assistant"
        if edit == "I":
            out.append((edit, wanted, ""))
            state = NEXT[state]
            continue
        role, text = roles[at], texts[at]
        at += 1
        if edit == "K":
            state = keeps_to(state, role)
        elif edit == "R":
            role, state = wanted, NEXT[state]
        out.append((edit, role, text))
    return out


# --- conversations of more than one part -----------------------------------------------------------------------------------------


AT = ["conv_id", "part", "seq"]


def _seen_before(parts: DataFrame) -> DataFrame:
    """For each part, the keys of its rows that an earlier part of the conversation holds."""
    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                own = {row_key(r, t) for r, t in zip(row["roles"], row["texts"])}
                if own:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([row[c]] * len(own), t) for c, t in zip(AT, (pa.int64(), pa.int32(), pa.int32()))] + [pa.array(sorted(own), pa.binary())],
                        names=[*AT, "key"],
                    )

    held = materialise(parts.mapInArrow(released(keys), "conv_id long, part int, seq int, key binary"), "conversation-keys")
    place = F.struct("part", "seq")
    first = held.groupBy("conv_id", "key").agg(F.min(place).alias("first"), F.count("*").alias("n")).filter("n > 1")
    same = F.col("a.conv_id").eqNullSafe(F.col("b.conv_id")) & (F.col("a.key") == F.col("b.key"))
    late = held.alias("a").join(first.alias("b"), same).filter(F.struct("a.part", "a.seq") > F.col("b.first"))
    return late.groupBy(*[F.col(f"a.{c}").alias(c) for c in AT]).agg(F.collect_list("a.key").alias("seen"))


def _costs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            found = faults(row["roles"], row["texts"], set(row["seen"] or ()))
            exits = [suffix_bounds(row["roles"], found, [0 if s == end else FAR for s in STATES])[0] for end in STATES]
            yield pa.RecordBatch.from_arrays(
                [pa.array([row[c]], t) for c, t in zip(AT, (pa.int64(), pa.int32(), pa.int32()))]
                + [pa.array([[exits[end][start] for start in STATES for end in STATES]], pa.list_(pa.int64()))], names=[*AT, "costs"],
            )


def _finishes(group: pd.DataFrame) -> pd.DataFrame:
    """Cost of all that follows each part, by the state at its end: from the last part backwards."""
    group = group.sort_values(["part", "seq"])
    finish, out = list(TO_END), []
    for costs in reversed(group["costs"].tolist()):
        out.append(finish)
        finish = [min(int(costs[4 * start + end]) + finish[end] for end in STATES) for start in STATES]
    group["finish"] = out[::-1]
    group["last"] = [False] * (len(group) - 1) + [True]
    return group[[*AT, "finish", "last"]]


def _ways(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            found = faults(row["roles"], row["texts"], set(row["seen"] or ()))
            ends = [search(row["roles"], found, start, row["finish"], row["last"])[2] for start in STATES]
            yield pa.RecordBatch.from_arrays(
                [pa.array([row[c]], t) for c, t in zip(AT, (pa.int64(), pa.int32(), pa.int32()))] + [pa.array([ends], pa.list_(pa.int64()))],
                names=[*AT, "ends"],
            )


def _entries(group: pd.DataFrame) -> pd.DataFrame:
    group = group.sort_values(["part", "seq"])
    state, out = NOTHING, []
    for ends in group["ends"].tolist():
        out.append(state)
        state = int(ends[state])
    group["entry"] = out
    return group[[*AT, "entry"]]


def _with(parts: DataFrame, more: DataFrame) -> DataFrame:
    same = F.col("p.conv_id").eqNullSafe(F.col("m.conv_id")) & (F.col("p.part") == F.col("m.part")) & (F.col("p.seq") == F.col("m.seq"))
    return parts.alias("p").join(more.alias("m"), same, "left").select("p.*", *[f"m.{c}" for c in more.columns if c not in AT])


REPAIRED = (
    "conv_id long, part int, seq int, present boolean, first_turn long, last_turn long, n_turns long, first_role string, last_role string, "
    "blank long, duplicate long, truncated long, illegal long, cost long, edits array<struct<edit string, role string, text string>>"
)
REPAIRED_FIELDS = pa.schema([
    ("conv_id", pa.int64()), ("part", pa.int32()), ("seq", pa.int32()), ("present", pa.bool_()), ("first_turn", pa.int64()),
    ("last_turn", pa.int64()), ("n_turns", pa.int64()), ("first_role", pa.string()), ("last_role", pa.string()), ("blank", pa.int64()),
    ("duplicate", pa.int64()), ("truncated", pa.int64()), ("illegal", pa.int64()), ("cost", pa.int64()),
    ("edits", pa.list_(pa.struct([("edit", pa.string()), ("role", pa.string()), ("text", pa.string())]))),
])


def _repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        held, chars = [], 0
        for row in batch.to_pylist():
            roles, texts = row["roles"], row["texts"]
            found = faults(roles, texts, set(row["seen"] or ()))
            entry = row["entry"] or NOTHING
            finish = TO_END if row["finish"] is None else row["finish"]
            _, audit, end = search(roles, found, entry, finish, row["last"] is not False)
            edits = applied(audit, roles, texts, entry)
            kept_truncated = sum(e != "D" and f == "t" for e, f in zip(audit.replace("I", ""), found))
            cost = DELETE * audit.count("D") + REROLE * audit.count("R") + INSERT * audit.count("I") + TRUNCATED * kept_truncated
            turns = [t for t in row["turns"] if t is not None]
            initials = [r[:1] for r in roles]
            held.append((
                row["conv_id"], row["part"], row["seq"], row["present"], turns[0] if turns else None, turns[-1] if turns else None,
                len(set(turns)), roles[0] if roles else None, roles[-1] if roles else None, found.count("b"), found.count("d"),
                found.count("t"), sum(a + b not in LEGAL_PAIRS for a, b in zip(initials, initials[1:])), cost,
                [{"edit": e, "role": r, "text": t} for e, r, t in edits],
            ))
            chars += sum(map(len, texts))
            if chars >= 2 * PART_CHARS:
                yield _batch(held, REPAIRED_FIELDS)
                held, chars = [], 0
        if held:
            yield _batch(held, REPAIRED_FIELDS)


def repair_conversations(rows: DataFrame, part_rows: int = PART_ROWS, part_chars: int = PART_CHARS) -> tuple[DataFrame, DataFrame]:
    """Cheapest repair of each conversation's rows (conv_id, turn, role, text, present), as parts with their edits.

    Returns two frames of the same columns: conversations of one part, and the parts of longer ones, ordered by (part, seq). `edits`
    holds (edit, role, text) for Keep, Rerole, Delete and Insert. Blank rows and rows said before (same role and text) are deleted;
    an undeleted truncated row costs more. What remains reads (system? (user assistant)+)?.

    A conversation that is one part is solved where it is read. For others the parts' costs from state to state are computed
    everywhere at once, a few numbers a part are linked backwards (what follows costs) and forwards (where each part begins), and
    each part is then searched on its own; no task holds a whole long conversation.

    Conversations whose rows are all dropped come with no edits; a null conv_id is a conversation of its own; null turns come
    first, equal turns are ordered by role and text; repeated rows are duplicates. Empty tables give no rows.
    """
    parts = conversation_parts(rows, part_rows, part_chars)
    long_ones = parts.groupBy("conv_id").agg(F.count("*").alias("n")).filter("n > 1").select("conv_id", F.lit(True).alias("long"))
    long_ones = materialise(long_ones, "conversation-long")
    same = F.col("p.conv_id").eqNullSafe(F.col("l.conv_id"))
    nothing = {
        "seen": F.lit(None).cast("array<binary>"), "finish": F.lit(None).cast("array<long>"), "last": F.lit(None).cast("boolean"),
        "entry": F.lit(None).cast("int"),
    }
    single = parts.alias("p").join(long_ones.alias("l"), same, "left_anti").withColumns(nothing).mapInArrow(released(_repaired), REPAIRED)
    if long_ones.isEmpty():
        return single, single.limit(0)
    several = materialise(parts.alias("p").join(long_ones.alias("l"), same, "left_semi"), "conversation-several")
    several = materialise(_with(several, _seen_before(several)), "conversation-several")
    at = "conv_id long, part int, seq int"
    costs = several.mapInArrow(released(_costs), f"{at}, costs array<long>")
    finishes = costs.groupBy("conv_id").applyInPandas(_finishes, f"{at}, finish array<long>, last boolean")
    several = materialise(_with(several, finishes), "conversation-several")
    ways = several.mapInArrow(released(_ways), f"{at}, ends array<long>")
    entries = ways.groupBy("conv_id").applyInPandas(_entries, f"{at}, entry int")
    return single, _with(several, entries).mapInArrow(released(_repaired), REPAIRED)


REPORT = (
    "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
)
REPORT_FIELDS = pa.schema([
    ("conv_id", pa.int64()), *[(c, pa.int64()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")],
    ("audit", pa.string()), ("repaired_sha256", pa.string()),
])


class _Report:
    """Figures of a conversation, part after part."""

    def __init__(self, conv_id: int | None):
        self.conv_id, self.counts, self.audit, self.sha = conv_id, [0] * 5, [], hashlib.sha256()
        self.low = self.high = self.role = None
        self.distinct, self.any = 0, False

    def add(self, row: dict) -> None:
        for k, name in enumerate(("blank", "duplicate", "truncated", "illegal", "cost")):
            self.counts[k] += row[name]
        if row["first_turn"] is not None:
            self.distinct += row["n_turns"] - (row["first_turn"] == self.high)
            self.low = row["first_turn"] if self.low is None else self.low
            self.high = row["last_turn"]
        if row["first_role"] is not None:
            self.counts[3] += self.role is not None and self.role[:1] + row["first_role"][:1] not in LEGAL_PAIRS
            self.role = row["last_role"]
        for e in row["edits"]:
            self.audit.append(e["edit"])
            if e["edit"] != "D":
                self.sha.update(f"{chr(10) if self.any else ''}{e['role']}:{e['text']}".encode())
                self.any = True

    def row(self) -> tuple:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.distinct
        return self.conv_id, gaps, *self.counts, "".join(self.audit), self.sha.hexdigest()


def _reports(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    report = None
    for batch in batches:
        held = []
        for row in batch.to_pylist():
            if report is None or report.conv_id != row["conv_id"]:
                if report is not None:
                    held.append(report.row())
                report = _Report(row["conv_id"])
            report.add(row)
        if held:
            yield _batch(held, REPORT_FIELDS)
    if report is not None:
        yield _batch([report.row()], REPORT_FIELDS)


def repair_report(single: DataFrame, several: DataFrame) -> DataFrame:
    """One row for each conversation: gaps in its turns, counted faults, cost, audit and SHA-256 of the repaired conversation.

    A digest needs its texts in order: parts of long conversations are dealt by conversation and streamed part after part.
    """
    in_order = several.repartition("conv_id").sortWithinPartitions(F.col("conv_id").asc_nulls_first(), "part", "seq")
    return single.mapInArrow(released(_reports), REPORT).unionByName(in_order.mapInArrow(released(_reports), REPORT))
