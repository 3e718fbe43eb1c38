"""Conversation structure repair: the cheapest edits that make a conversation's roles ``(s?(ua)+)?``, found by integer minima.

A conversation is a path through a graph without cycles: a layer for each turn, four states in each (nothing said, system
said, a user waits, pairs are whole). An edge is what happens to one turn: turns inserted before it, then it is kept, given
another role or deleted. The weight of an edge is one big integer. Its high digits are the cost; below them each turn has
digits of its own, wide enough for the letters of its edits and filled with zeros behind them. A path's weight is the sum, and
the least sum is the cheapest repair and among these the one whose letters come first: every turn's letters end with the only
one that isn't an insertion, so none is the beginning of another and the fixed places order paths as their letters do. The
zeros behind the last insertions order a shorter end before a longer one.

Turns are sorted by ranges and solved in blocks of 512, a least weight for each pair of states at a block's ends, so a
conversation of any length is spread over tasks and no integer outgrows a block. The blocks of a conversation are then joined
in order; there the letters of what came before are represented by their rank among the four states. The texts of a
conversation pass one task in order, one at a time, since its digest can't be computed in pieces.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm._common import WORDS, Scratch, read, with_groups

BLOCK = 512
KEEP, REROLE, DELETE, INSERT = 0, 3, 4, 3
TRUNCATED = 3
FAULTS = ("", "blank", "duplicate", "truncated")

#: States: nothing said, system said, a user waits for an answer, pairs are whole.
NONE, SYSTEM, WAITING, WHOLE = range(4)
_SAY = {"s": {NONE: SYSTEM}, "u": {NONE: WAITING, SYSTEM: WAITING, WHOLE: WAITING}, "a": {WAITING: WHOLE}}
#: Letters as digits of three bits, in the order of their code points; zero is padding.
_LETTERS = "DIKR"
_DIGIT = 3
#: Letters of one turn: two insertions at most, since a third would come back to a state already met, and its own.
_PLACES = 3


def _digits(letters: str, places: int) -> int:
    out = 0
    for k in range(places):
        out = out << _DIGIT | (_LETTERS.index(letters[k]) + 1 if k < len(letters) else 0)
    return out


def _letters(weight: int, places: int) -> str:
    found = (weight >> _DIGIT * (places - 1 - k) & 7 for k in range(places))
    return "".join(_LETTERS[d - 1] for d in found if d)


def _inserted(state: int) -> list[tuple[int, str]]:
    """(state, letters) after none, one or two insertions of the turn that may follow."""
    out = [(state, "")]
    for _ in range(_PLACES - 1):
        now, letters = out[-1]
        out.append((WHOLE if now == WAITING else WAITING, letters + "I"))
    return out


def _edges(initial: str, fault: str) -> list[tuple[int, int, int, int]]:
    """(from, to, cost, digits): the least weight for each pair of states that a turn of this kind can join."""
    least: dict[tuple[int, int], int] = {}
    for state in range(4):
        for between, before in _inserted(state):
            cost = INSERT * len(before)
            ways = [(between, cost + DELETE, "D")]
            if fault not in ("blank", "duplicate"):
                cost += TRUNCATED if fault == "truncated" else 0
                if between in _SAY.get(initial, {}):
                    ways.append((_SAY[initial][between], cost + KEEP, "K"))
                ways += [(_SAY[role][between], cost + REROLE, "R") for role in "ua" if between in _SAY[role]]
            for to, spent, letter in ways:
                weight = spent << _DIGIT * _PLACES | _digits(before + letter, _PLACES)
                least[state, to] = min(weight, least.get((state, to), weight))
    low = (1 << _DIGIT * _PLACES) - 1
    return [(a, b, w >> _DIGIT * _PLACES, w & low) for (a, b), w in least.items()]


_EDGES = {(initial, fault): _edges(initial, fault) for initial in ("s", "u", "a", "") for fault in FAULTS}
#: The end of a conversation: (state, cost, digits of the insertions that make it whole).
_ENDS = [(NONE, 0, 0), (WHOLE, 0, 0), (WAITING, INSERT, _digits("I", 2)), (SYSTEM, 2 * INSERT, _digits("II", 2))]


def solve_block(turns: list[tuple[str, str]]) -> list[int | None]:
    """The least weight for each (first state, last state) over turns of (initial, fault); None where no path leads."""
    width = _DIGIT * _PLACES * len(turns)
    paths: list[list[int | None]] = [[0 if a == b else None for b in range(4)] for a in range(4)]
    for k, kind in enumerate(turns):
        place = width - _DIGIT * _PLACES * (k + 1)
        edges = [(a, b, (cost << width) + (digits << place)) for a, b, cost, digits in _EDGES[kind]]
        for start in range(4):
            at, to = paths[start], [None] * 4
            for a, b, weight in edges:
                if at[a] is not None and (to[b] is None or at[a] + weight < to[b]):
                    to[b] = at[a] + weight
            paths[start] = to
    return [w for row in paths for w in row]


class Joined:
    """The blocks of one conversation, taken one after the other."""

    def __init__(self) -> None:
        self.cost: list[int | None] = [0, None, None, None]
        self.rank = [0, 0, 0, 0]
        self.steps: list[tuple[int, list[tuple[int, int] | None]]] = []

    def add(self, turns: int, weights: list[int | None]) -> None:
        width = _DIGIT * _PLACES * turns
        low = (1 << width) - 1
        best: list[tuple[int, int] | None] = [None] * 4
        for a in range(4):
            for b in range(4):
                weight = weights[4 * a + b]
                if self.cost[a] is not None and weight is not None:
                    whole = (self.cost[a] + (weight >> width)) << width + 2 | self.rank[a] << width | weight & low
                    if best[b] is None or whole < best[b][0]:
                        best[b] = (whole, a)
        order = sorted({w[0] & (low << 2 | 3) for w in best if w})  # letters alone: of equal ones the ranks are equal
        self.cost = [w and w[0] >> width + 2 for w in best]
        self.rank = [order.index(w[0] & (low << 2 | 3)) if w else 0 for w in best]
        self.steps.append((turns, [w and (w[1], w[0] & low) for w in best]))

    def finished(self) -> tuple[int, str]:
        """(cost, audit)."""
        whole, at = min(((self.cost[s] + cost) << 8 | self.rank[s] << 6 | digits, s) for s, cost, digits in _ENDS if self.cost[s] is not None)
        parts = [_letters(whole & 63, 2)]
        for turns, ways in reversed(self.steps):
            at, digits = ways[at]
            parts.append(_letters(digits, _PLACES * turns))
        return whole >> 8, "".join(reversed(parts))


def _runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, list[tuple]]]:
    """(key, rows) of equal keys that follow each other; the other columns are the rows' values. Keys hold bounded groups."""
    key, held = None, []
    for batch in batches:
        columns = [batch[name].to_pylist() for name in batch.schema.names]
        for row in zip(*columns, strict=True):
            now = row[: len(keys)]
            if now != key:
                if held:
                    yield key, held
                key, held = now, []
            held.append(row[len(keys) :])
    if held:
        yield key, held


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out: list[tuple] = []

    def batch() -> pa.RecordBatch:
        columns = list(zip(*out, strict=True))
        types = [pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.binary())]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["nameless", "conv", "block", "turns", "weights"])

    for key, rows in _runs(batches, ["nameless", "conv", "block"]):
        weights = solve_block([(initial if initial in _SAY else "", fault) for _, initial, fault in rows])
        out.append((*key, len(rows), [None if w is None else w.to_bytes(-(-w.bit_length() // 8), "big") for w in weights]))
        if len(out) >= 1000:
            yield batch()
            out.clear()
    if out:
        yield batch()


def _solutions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out, now, joined = [], None, None

    def batch() -> pa.RecordBatch:
        columns = list(zip(*out, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.bool_(), pa.int64(), pa.int64(), pa.string()], strict=True)], names=["nameless", "conv", "cost", "audit"])

    for part in batches:
        for nameless, conv, _, turns, weights in zip(*(part[name].to_pylist() for name in part.schema.names), strict=True):
            if (nameless, conv) != now:
                if joined:
                    out.append((*now, *joined.finished()))
                now, joined = (nameless, conv), Joined()
            joined.add(turns, [None if w is None else int.from_bytes(w, "big") for w in weights])
        if len(out) >= 1000:
            yield batch()
            out.clear()
    if joined:
        out.append((*now, *joined.finished()))
    if out:
        yield batch()


def ordered_turns(turns: DataFrame, scratch: Scratch) -> DataFrame:
    """(nameless, conv, n, turn, role, text, k1, k2, fault): n orders the turns of each conversation; fault is the first that holds.

    Turns are in the order of turn (null first), role and a hash of the text; rows that repeat may stand in any order.
    """
    role, text = F.coalesce(F.col("role").cast("string"), F.lit(" ")), F.coalesce(F.col("text").cast("string"), F.lit(" "))
    rows = turns.select(F.col("conv_id").isNull().alias("nameless"), F.coalesce(F.col("conv_id").cast("long"), F.lit(0)).alias("conv"), F.col("turn").cast("long"), role.alias("role"), text.alias("text"))
    rows = rows.withColumn("k1", F.xxhash64("role", "text")).withColumn("k2", F.xxhash64("text", "role")).withColumn("row", F.monotonically_increasing_id())
    order = [F.col("nameless"), F.col("conv"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("k1"), F.col("k2"), F.col("row")]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).drop("row").withColumn("n", F.monotonically_increasing_id())
    last = F.right(F.rtrim(F.translate("text", "\t\n\x0b\x0c\r", "     ")), F.lit(1))
    blank = ~F.col("text").rlike(WORDS)
    rows = scratch.table(rows.withColumn("blank", blank).withColumn("cut", ~last.isin(".", "!", "?")), "turns")
    keys = ["nameless", "conv", "k1", "k2"]
    copies = scratch.table(rows.groupBy(*keys).agg(F.min("n").alias("first"), F.count("*").alias("copies")).filter("copies > 1"), "copies")
    flagged = with_groups(rows, copies, keys, "copies", "left")
    fault = F.when(F.col("blank"), "blank").when(F.col("n") > F.col("first"), "duplicate").when(F.col("cut"), "truncated").otherwise("")
    return scratch.table(flagged.select("nameless", "conv", "n", "turn", "role", "text", fault.alias("fault")), "flagged")


def cheapest_edits(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """(nameless, conv, cost, audit) for each conversation of ``ordered_turns``."""
    kinds = rows.select("nameless", "conv", F.floor(F.col("n") / BLOCK).alias("block"), "n", F.substring("role", 1, 1).alias("initial"), "fault")
    blocks = kinds.repartition("nameless", "conv", "block").sortWithinPartitions("nameless", "conv", "block", "n")
    blocks = scratch.table(blocks.mapInArrow(_blocks, "nameless boolean, conv long, block long, turns long, weights array<binary>"), "blocks")
    joined = blocks.repartition("nameless", "conv").sortWithinPartitions("nameless", "conv", "block")
    return scratch.table(joined.mapInArrow(_solutions, "nameless boolean, conv long, cost long, audit string"), "solutions")


_EDITS = "conv_id long, no long, edit string, turn long, old_role string, fault string, place long, role string, text string, cost long"
_EDITS_ARROW = pa.schema([(x.split()[0], pa.string() if x.endswith("string") else pa.int64()) for x in _EDITS.split(", ")])


class _Audit:
    """The edits of one conversation, applied to its turns as they come."""

    def __init__(self, conv: int | None, cost: int, audit: str):
        self.conv, self.cost, self.audit, self.at, self.said, self.waiting = conv, cost, audit, 0, 0, False

    def edit(self, out: list[tuple], turn: int | None = None, old_role: str | None = None, fault: str | None = None, text: str = "") -> None:
        letter, role, place = self.audit[self.at], None, None
        if letter != "D":
            role = old_role if letter == "K" else "assistant" if self.waiting else "user"
            self.waiting, place, self.said = role[:1] == "u", self.said, self.said + 1
        out.append((self.conv, self.at, letter, turn, old_role, fault, place, role, text, self.cost))
        self.at += 1

    def inserts(self, out: list[tuple]) -> None:
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            self.edit(out)


def _edited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Applies each conversation's audit, which its first row carries."""

    def batch_of(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _EDITS_ARROW, strict=True)], schema=_EDITS_ARROW)

    now = None
    for batch in batches:
        out: list[tuple] = []
        for nameless, conv, n, turn, role, text, fault, cost, audit in zip(*(batch[name].to_pylist() for name in batch.schema.names), strict=True):
            if n < 0:
                if now:
                    now.inserts(out)
                now = _Audit(None if nameless else conv, cost, audit)
                out.append((now.conv, -1, None, None, None, None, None, None, None, cost))
            else:
                now.inserts(out)
                now.edit(out, turn, role, fault, text)
        if out:
            yield batch_of(out)
    out = []
    if now:
        now.inserts(out)
    if out:
        yield batch_of(out)


def conversation_edits(turns: DataFrame, conversations: DataFrame | None = None, scratch: Scratch | None = None) -> DataFrame:
    """(conv_id, no, edit, turn, old_role, fault, place, role, text, cost): the edits of each conversation of ``turns`` in order.

    ``turns`` has conv_id, turn, role and text. edit is K, R, D or I; role and text are what stands at place afterwards. A row
    with no -1 and no edit opens each conversation, also those of ``conversations`` (conv_id) that have no turns. Rows lie in
    order within partitions. A null role or text counts as one blank, an empty role can't be kept; rows without a conv_id are
    one conversation; null turns come first. Rows of equal turn are in the order of role and a hash of the text; of rows that
    repeat all but one are duplicates. An empty table gives no rows. Other columns are ignored.
    """
    scratch = scratch or Scratch(turns.sparkSession)
    rows = ordered_turns(turns, scratch)
    solved = cheapest_edits(rows, scratch)
    named = turns.select("conv_id") if conversations is None else conversations.select("conv_id")
    named = named.select(F.col("conv_id").isNull().alias("nameless"), F.coalesce(F.col("conv_id").cast("long"), F.lit(0)).alias("conv")).distinct()
    nothing = {"n": F.lit(-1).cast("long"), "turn": F.lit(None).cast("long"), "role": F.lit(None).cast("string"), "text": F.lit(None).cast("string"), "fault": F.lit(None).cast("string")}
    heads = named.join(solved, ["nameless", "conv"], "full").select("nameless", "conv", *(v.alias(k) for k, v in nothing.items()), F.coalesce("cost", F.lit(0)).alias("cost"), F.coalesce("audit", F.lit("")).alias("audit"))
    rows = rows.select("nameless", "conv", *nothing, F.lit(None).cast("long").alias("cost"), F.lit(None).cast("string").alias("audit"))
    together = heads.unionByName(rows).repartition("nameless", "conv").sortWithinPartitions("nameless", "conv", "n")
    return together.mapInArrow(_edited, _EDITS)


def repaired_conversations(turns: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """(conv_id, turn, role, text): the repaired turns, numbered from 0. Nulls and ties are as in ``conversation_edits``."""
    kept = conversation_edits(turns, scratch=scratch).filter("edit IN ('K', 'R', 'I')")
    return kept.select("conv_id", F.col("place").alias("turn"), "role", "text")


_REPORT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def _reported(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([(x.split()[0], pa.string() if x.endswith("string") else pa.int64()) for x in _REPORT.split(", ")])
    now, names = None, ["conv_id", "edit", "turn", "old_role", "fault", "role", "text", "cost"]

    def row() -> tuple:
        gaps = now["high"] - now["low"] + 1 - now["turns"] if now["turns"] else 0
        return (now["conv"], gaps, *(now[f] for f in FAULTS[1:]), now["illegal"], now["cost"], "".join(now["audit"]), now["sha"].hexdigest())

    def batch_of(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    for batch in batches:
        out = []
        for conv, edit, turn, old_role, fault, role, text, cost in zip(*(batch[name].to_pylist() for name in names), strict=True):
            if edit is None:
                if now:
                    out.append(row())
                now = {"conv": conv, "low": None, "high": None, "turns": 0, "last": None, "illegal": 0, "cost": cost, "audit": [], "sha": hashlib.sha256(), "said": 0, **dict.fromkeys(FAULTS, 0)}
                continue
            now["audit"].append(edit)
            if edit != "I":
                now[fault] += 1
                if turn is not None and turn != now["high"]:
                    now["low"] = turn if now["low"] is None else now["low"]
                    now["high"], now["turns"] = turn, now["turns"] + 1
                if now["last"] is not None and now["last"] + old_role[:1] not in ("su", "ua", "au"):
                    now["illegal"] += 1
                now["last"] = old_role[:1]
            if edit != "D":
                now["sha"].update((b"\n" if now["said"] else b"") + f"{role}:{text}".encode())
                now["said"] += 1
        if out:
            yield batch_of(out)
    if now:
        yield batch_of([row()])


def repair_report(turns: DataFrame, conversations: DataFrame | None = None, scratch: Scratch | None = None) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) for each conversation.

    Read from the edits alone, in their order. A conversation without turns has zeros, no audit and the hash of nothing.
    Nulls, ties, repeated rows, empty tables and other columns are as in ``conversation_edits``.
    """
    return conversation_edits(turns, conversations, scratch).mapInArrow(_reported, _REPORT)


def damaged(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) with faults by crc32(conv_id:turn) % 20: 0 drops a row, 1 empties its text, 2 takes its
    ``[.!?]``, 3 repeats it, 4 makes its role user. Nulls count as one blank, in the key too; a null conv_id or turn stays null.
    """

    def part(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))

    kind = F.crc32(F.concat(part("conv_id"), F.lit(":"), part("turn")).cast("binary")) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(part("text"), "[.!?]", "")).otherwise(part("text"))
    role = F.when(kind == 4, "user").otherwise(part("role"))
    times = F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return turns.filter(kind != 0).select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(times).alias("_time")).drop("_time")


def op12_chat_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read(spark, sf_dir, "conversations")
    return repair_report(damaged(turns), turns)


#: The cheapest edits by a step for each turn: of each state the least of zero-padded cost and letters.
ORACLE_SQL = r"""
WITH RECURSIVE bits AS (SELECT b::BIGINT AS c, b AS byte, 0 AS k FROM range(256) t(b) UNION ALL
  SELECT CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, byte, k + 1 FROM bits WHERE k < 8),
tab AS MATERIALIZED (SELECT list(c ORDER BY byte) AS t FROM bits WHERE k = 8),
src AS (SELECT *, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key FROM conversations),
keyed AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(key, ''), lambda x: ascii(x)::BIGINT)),
  lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1])), 4294967295) % 20 AS kind FROM src, tab),
dam AS (SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
  unnest(range(CASE kind WHEN 3 THEN 2 ELSE 1 END)) AS time FROM keyed WHERE kind <> 0),
pos AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, time) AS i FROM dam),
flt AS (SELECT *, substr(role, 1, 1) AS ini, lag(substr(role, 1, 1)) OVER (PARTITION BY conv_id ORDER BY i) || substr(role, 1, 1) AS two,
  CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
    WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 'truncated' ELSE '' END AS fault FROM pos),
ins(p, q, letters) AS (VALUES (0, 0, ''), (1, 1, ''), (2, 2, ''), (3, 3, ''), (0, 2, 'I'), (1, 2, 'I'), (3, 2, 'I'), (2, 3, 'I'), (0, 3, 'II'), (1, 3, 'II'), (3, 3, 'II'), (2, 2, 'II')),
say(ini, p, q) AS (VALUES ('s', 0, 1), ('u', 0, 2), ('u', 1, 2), ('u', 3, 2), ('a', 2, 3)),
edge AS (SELECT p, q, 'D' AS edit, '' AS ini, letters || 'D' AS letters, 4 + 3 * length(letters) AS cost FROM ins
  UNION ALL SELECT ins.p, say.q, 'K', say.ini, letters || 'K', 3 * length(letters) FROM ins JOIN say ON say.p = ins.q
  UNION ALL SELECT ins.p, say.q, 'R', '', letters || 'R', 3 + 3 * length(letters) FROM ins JOIN say ON say.p = ins.q WHERE say.ini IN ('u', 'a')),
dp AS (SELECT DISTINCT conv_id, 0::BIGINT AS i, 0 AS s, lpad('0', 8, '0') AS best FROM conversations UNION ALL
  SELECT dp.conv_id, dp.i + 1, edge.q, min(lpad((substr(best, 1, 8)::INT + edge.cost + CASE WHEN fault = 'truncated' AND edit <> 'D' THEN 3 ELSE 0 END)::VARCHAR, 8, '0') || substr(best, 9) || edge.letters)
  FROM dp JOIN flt ON flt.conv_id IS NOT DISTINCT FROM dp.conv_id AND flt.i = dp.i + 1
    JOIN edge ON edge.p = dp.s AND (edit = 'D' OR (fault NOT IN ('blank', 'duplicate') AND (edit = 'R' OR edge.ini = flt.ini)))
  GROUP BY dp.conv_id, dp.i, edge.q),
many AS (SELECT c.conv_id, count(flt.i) AS n FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN flt ON flt.conv_id IS NOT DISTINCT FROM c.conv_id GROUP BY c.conv_id),
fin AS (SELECT dp.conv_id, min(CASE s WHEN 1 THEN lpad((substr(best, 1, 8)::INT + 6)::VARCHAR, 8, '0') || substr(best, 9) || 'II'
    WHEN 2 THEN lpad((substr(best, 1, 8)::INT + 3)::VARCHAR, 8, '0') || substr(best, 9) || 'I' ELSE best END) AS best
  FROM dp JOIN many ON many.conv_id IS NOT DISTINCT FROM dp.conv_id AND many.n = dp.i GROUP BY dp.conv_id),
let AS (SELECT conv_id, substr(best, 1, 8)::BIGINT AS cost, substr(best, 9) AS audit, unnest(range(1, length(best) - 7)) AS k FROM fin),
cut AS (SELECT conv_id, audit, k, substr(audit, k, 1) AS edit, length(replace(substr(audit, 1, k), 'I', '')) AS i, length(replace(substr(audit, 1, k), 'D', '')) AS m, length(replace(audit, 'D', '')) AS total FROM let),
rep AS (SELECT cut.conv_id, string_agg(CASE edit WHEN 'K' THEN flt.role ELSE CASE WHEN (total - m) % 2 = 0 THEN 'assistant' ELSE 'user' END END || ':' || CASE edit WHEN 'I' THEN '' ELSE flt.text END, chr(10) ORDER BY k) AS said
  FROM cut LEFT JOIN flt ON flt.conv_id IS NOT DISTINCT FROM cut.conv_id AND flt.i = cut.i WHERE edit <> 'D' GROUP BY cut.conv_id),
cnt AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
  count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (two NOT IN ('su', 'ua', 'au')) AS illegal FROM flt GROUP BY conv_id)
SELECT fin.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  substr(best, 1, 8)::BIGINT AS cost, substr(best, 9) AS audit, sha256(coalesce(said, '')) AS repaired_sha256
FROM fin LEFT JOIN cnt ON cnt.conv_id IS NOT DISTINCT FROM fin.conv_id LEFT JOIN rep ON rep.conv_id IS NOT DISTINCT FROM fin.conv_id
"""
