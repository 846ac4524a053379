"""Repair of conversations by A* on the lattice of edits.

Rows stand in order of their turns. A row is at fault where it is blank, or a duplicate of an earlier one, or truncated; `Keep` costs
nothing, `Rerole` and `Insert` 3, `Delete` 4, and an undeleted truncated row 3 more. The cheapest edits whose roles then
read `(s?(ua)+)?` are wanted, and among them the ASCII-least string of their initials.

A node of the lattice is (rows behind it, state of that pattern). Its heuristic is the suffix sum of what no path can
avoid: 4 for a row that must be deleted, 3 for a truncated one. It is consistent, so with the agenda keyed by (cost plus heuristic,
edits so far) the first visit of a node has its least cost and then its least string.

Conversations may be of any length, so `size` rows at a time are searched, each from every state it may begin in, and give the best way
to each state it may end in; a chunk's inserts stand before one of its rows, so that no way of a chunk begins another one. Hence the order
of two ways up to a chunk's end is that of their parts, and `chosen` joins chunks in one pass over them with four costs and four places in that
order. No task holds a conversation's texts: the lattice sees two characters a row, places of rows come
from `ranks`, duplicates from partial aggregation, and the digest reads rows as a stream.

`edited` gives an edit for each row, `repaired` the rows that result, `report` the figures of each conversation.

Defined results: a null role or text is one space; null turns stand first; rows of one turn stand in order of role and text; a null
conv_id is a conversation of its own; a role's first character is its initial, and only s, u and a fit the pattern; an empty table has no conversations. Other columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.base import crc32_sql, private, shared_dir, shuffle_partitions, small_batches, stored
from quillon.llm.bpe import batches
from quillon.llm.ranks import ranked, same

#: Costs of edits, and the further cost of an undeleted truncated row. Fixed by the contract.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: Rows of a conversation that are searched at once.
CHUNK = 1024
#: States of `(s?(ua)+)?`: nothing yet, after s, after u, after a. The state after a user's or assistant's row, where one fits.
NEXT = (2, 2, 3, 2)
KEPT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}
#: What a conversation that ends in a state still needs, or nothing where it is whole.
TAIL = ("", "II", "I", "")
SPACES = " \t\n\x0b\x0c\r"


def damaged(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text): the contract's damage by crc32 of `conv_id:turn`."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(part("conv_id"), F.lit(":"), part("turn")).cast("binary")) % 20
    given = private(rows, conv_id=F.col("conv_id"), turn=F.col("turn"), role=part("role"), text=part("text"), kind=kind).where("kind <> 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.explode(F.array_repeat(F.lit(0), F.when(F.col("kind") == 3, 2).otherwise(1)))
    return given.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), copies.alias("copy")).drop("copy")


def faulted(rows: DataFrame, folder: str) -> DataFrame:
    """Rows with `rank` and `fault`: B blank, D duplicate, T truncated, or - for none; the first that holds."""
    given = private(rows, conv_id=F.col("conv_id"), turn=F.col("turn"), role=F.coalesce("role", F.lit(" ")), text=F.coalesce("text", F.lit(" ")))
    placed = ranked(given, ["conv_id"], ["turn", "role", "text"], f"{folder}/ranked", near=["turn", "role", F.substring("text", 1, 32)])
    said = F.sha2(F.col("text").cast("binary"), 256)
    first = placed.groupBy(F.col("conv_id").alias("_c"), F.col("role").alias("_r"), said.alias("_s")).agg(F.min("rank").alias("_first"))
    at = same(F.col("conv_id"), F.col("_c")) & (F.col("rank") == F.col("_first")) & (F.col("role") == F.col("_r")) & (said == F.col("_s"))
    bare = F.rtrim("text", F.lit(SPACES))
    fault = F.when(bare == "", "B").when(F.col("_first").isNull(), "D").when(~F.right(bare, F.lit(1)).isin(".", "!", "?"), "T").otherwise("-")
    return stored(placed.join(first, at, "left").select("conv_id", "turn", "role", "text", "rank", fault.alias("fault")), f"{folder}/faulted")


def ways(faults: str, roles: str, start: int) -> dict[int, tuple[int, str]]:
    """For each state in which a chunk can end, the least (cost, edits) from `start`."""
    n = len(faults)
    ahead = [0] * (n + 1)
    for k in range(n - 1, -1, -1):
        ahead[k] = ahead[k + 1] + (DELETE if faults[k] in "BD" else TRUNCATED if faults[k] == "T" else 0)
    agenda, seen, found = [(ahead[0], "", 0, start)], set(), {}
    while agenda and len(found) < len(NEXT):
        f, edits, k, state = heapq.heappop(agenda)
        if (k, state) in seen:
            continue
        seen.add((k, state))
        cost = f - ahead[k]
        if k == n:
            found[state] = (cost, edits)
            continue
        steps = [("D", DELETE, k + 1, state), ("I", INSERT, k, NEXT[state])]
        if faults[k] not in "BD":
            more = TRUNCATED if faults[k] == "T" else 0
            kept = KEPT.get((state, roles[k]))
            if kept is not None:
                steps.append(("K", more, k + 1, kept))
            if kept != NEXT[state]:
                steps.append(("R", REROLE + more, k + 1, NEXT[state]))
        for edit, price, to, then in steps:
            if (to, then) not in seen:
                heapq.heappush(agenda, (cost + price + ahead[to], edits + edit, to, then))
    return found


def illegal(roles: str) -> int:
    """Neighbours other than su, ua and au."""
    return sum(a + b not in ("su", "ua", "au") for a, b in zip(roles, roles[1:], strict=False))


def searched(rows: DataFrame, size: int = CHUNK) -> DataFrame:
    """(conv_id, chunk, faults, roles, ways): each chunk's rows as characters, and its best ways by (start, end)."""
    initial = F.substring("role", 1, 1)
    seen = F.struct("rank", "fault", F.when(initial.isin("s", "u", "a"), initial).otherwise("-").alias("initial"))
    held = rows.groupBy("conv_id", F.expr(f"rank div {size}").alias("chunk")).agg(F.sort_array(F.collect_list(seen)).alias("x"))
    held = held.select("conv_id", "chunk", F.array_join("x.fault", "").alias("faults"), F.array_join("x.initial", "").alias("roles"))
    way = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("cost", pa.int64()), ("edits", pa.string())])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            found = []
            for chunk, faults, roles in zip(*(part.column(c).to_pylist() for c in ("chunk", "faults", "roles")), strict=True):
                starts = (0,) if chunk == 0 else range(len(NEXT))
                found.append([{"start": s, "end": e, "cost": c, "edits": x} for s in starts for e, (c, x) in ways(faults, roles, s).items()])
            yield part.append_column("ways", pa.array(found, pa.list_(way)))

    small_batches(rows.sparkSession)
    return held.mapInArrow(run, f"conv_id {held.schema['conv_id'].dataType.simpleString()}, chunk bigint, faults string, roles string, ways array<struct<`start`:int,`end`:int,cost:bigint,edits:string>>")


def _joined(chunks: list[dict]) -> list[tuple[int, str, int]]:
    """(state, edits, cost) of every chunk of a conversation on its best way."""
    ends: dict[int, tuple[int, int]] = {0: (0, 0)}  # state -> cost, place in the order of the ways' edits
    back: list[dict[int, dict]] = []
    for c in chunks:
        best: dict[int, tuple[int, int, str, dict]] = {}
        for w in c["ways"]:
            if w["start"] in ends:
                cost, place = ends[w["start"]]
                key = (cost + w["cost"], place, w["edits"], w)
                if w["end"] not in best or key[:3] < best[w["end"]][:3]:
                    best[w["end"]] = key
        order = sorted(best, key=lambda e: best[e][1:3])
        ends = {e: (best[e][0], order.index(e)) for e in best}
        back.append({e: best[e][3] for e in best})
    end = min(ends, key=lambda e: (ends[e][0] + INSERT * len(TAIL[e]), ends[e][1]))
    out, tail = [], TAIL[end]
    for ways_here in reversed(back):
        w = ways_here[end]
        out.append((w["start"], w["edits"] + tail, w["cost"] + INSERT * len(tail)))
        end, tail = w["start"], ""
    return out[::-1]


def chosen(chunks: DataFrame) -> DataFrame:
    """(conv_id, chunk, state, edits, cost, illegal, roles, before): the parts of each conversation's cheapest way; before counts the rows that earlier chunks leave."""
    schema = "conv_id bigint, chunk bigint, state int, edits string, cost bigint, illegal bigint, roles string, before bigint"
    out = pa.schema([("conv_id", pa.int64()), ("chunk", pa.int64()), ("state", pa.int32()), ("edits", pa.string()), ("cost", pa.int64()), ("illegal", pa.int64()), ("roles", pa.string()), ("before", pa.int64())])

    def whole(held: list[dict]):
        before, last = 0, ""
        for c, (state, edits, cost) in zip(held, _joined(held), strict=True):
            yield c["conv_id"], c["chunk"], state, edits, cost, illegal(last + c["roles"]), c["roles"], before
            before += len(edits) - edits.count("D")
            last = c["roles"][-1:]

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            held: list[dict] = []
            for part in parts:
                for c in part.to_pylist():
                    if held and held[0]["conv_id"] != c["conv_id"]:
                        yield from whole(held)
                        held = []
                    held.append(c)
            if held:
                yield from whole(held)

        return batches(rows(), out, lambda r: len(r[3]) + len(r[6]))

    dealt = chunks.select(F.col("conv_id").cast("long").alias("conv_id"), "chunk", "roles", "ways")
    return dealt.repartition(shuffle_partitions(chunks.sparkSession), "conv_id").sortWithinPartitions("conv_id", "chunk").mapInArrow(run, schema)


def edited(parts: DataFrame, size: int = CHUNK) -> DataFrame:
    """(conv_id, rank, edit, position, role): every edit; rank is null for an inserted row, position for a deleted one, role where it stays."""
    out = pa.schema([("conv_id", pa.int64()), ("rank", pa.int64()), ("edit", pa.string()), ("position", pa.int64()), ("role", pa.string())])

    def run(given: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for part in given:
                for c in part.to_pylist():
                    k, state, position = 0, c["state"], c["before"]
                    for edit in c["edits"]:
                        rank = None if edit == "I" else c["chunk"] * size + k
                        if edit == "D":
                            yield c["conv_id"], rank, edit, None, None
                        else:
                            state = KEPT[state, c["roles"][k]] if edit == "K" else NEXT[state]
                            yield c["conv_id"], rank, edit, position, None if edit == "K" else ("user", "assistant")[state - 2]
                            position += 1
                        k += edit != "I"

        return batches(rows(), out, lambda r: 48)

    return parts.mapInArrow(run, "conv_id bigint, rank bigint, edit string, position bigint, role string")


def repaired(rows: DataFrame, edits: DataFrame) -> DataFrame:
    """(conv_id, position, role, text) after the edits; rows are those of `faulted`."""
    old = rows.select(F.col("conv_id").alias("_c"), F.col("rank").alias("_k"), F.col("role").alias("_role"), "text")
    stay = edits.where("rank is not null and edit <> 'D'").join(old, same(F.col("conv_id"), F.col("_c")) & (F.col("rank") == F.col("_k")))
    new = edits.where("rank is null").select("conv_id", "position", "role", F.lit("").alias("text"))
    return stay.select("conv_id", "position", F.coalesce("role", "_role").alias("role"), "text").unionByName(new)


def hashed(turns: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256): the hash of `role:text` of a conversation's rows with line breaks between, read as a stream."""
    out = pa.schema([("conv_id", pa.int64()), ("repaired_sha256", pa.string())])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            now, held = None, None
            for part in parts:
                for key, line in zip(part.column(0).to_pylist(), part.column(2).to_pylist(), strict=True):
                    if held is None or key != now:
                        if held is not None:
                            yield now, held.hexdigest()
                        now, held = key, hashlib.sha256()
                    else:
                        held.update(b"\n")
                    held.update(line)
            if held is not None:
                yield now, held.hexdigest()

        return batches(rows(), out, lambda r: 80)

    lines = turns.select("conv_id", "position", F.concat("role", F.lit(":"), "text").cast("binary").alias("line"))
    return lines.repartition(shuffle_partitions(turns.sparkSession), "conv_id").sortWithinPartitions("conv_id", "position").mapInArrow(run, "conv_id bigint, repaired_sha256 string")


class Repair:
    """All results for rows (conv_id, turn, role, text); what several of them need is written once."""

    def __init__(self, rows: DataFrame, size: int = CHUNK):
        self.size = size
        folder = shared_dir(rows.sparkSession)
        small_batches(rows.sparkSession)
        self.rows = faulted(rows.withColumn("conv_id", F.col("conv_id").cast("long")), folder)
        self.parts = stored(chosen(searched(self.rows, size)), f"{folder}/chosen")

    def edits(self) -> DataFrame:
        return edited(self.parts, self.size)

    def turns(self) -> DataFrame:
        return repaired(self.rows, self.edits())

    def report(self, conversations: DataFrame) -> DataFrame:
        """What the contract asks for, of every conv_id of `conversations`, also of those without rows."""
        empty = hashlib.sha256(b"").hexdigest()
        turns = self.rows.groupBy("conv_id").agg((F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")).alias("gaps"))
        counts = self.rows.groupBy("conv_id").agg(*[F.count_if(F.col("fault") == k).alias(name) for k, name in (("B", "blank"), ("D", "duplicate"), ("T", "truncated"))])
        audit = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("chunk", "edits"))), lambda x: x["edits"]), "")
        costs = self.parts.groupBy("conv_id").agg(F.sum("illegal").alias("illegal"), F.sum("cost").alias("cost"), audit.alias("audit"))
        found = conversations.select(F.col("conv_id").cast("long").alias("conv_id"))
        for more in (turns, counts, costs, hashed(self.turns())):
            found = found.unionByName(more, allowMissingColumns=True)
        longs = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
        return found.groupBy("conv_id").agg(
            *[F.coalesce(F.max(c), F.lit(0)).cast("long").alias(c) for c in longs],
            F.coalesce(F.max("audit"), F.lit("")).alias("audit"),
            F.coalesce(F.max("repaired_sha256"), F.lit(empty)).alias("repaired_sha256"),
        )


_CRC = crc32_sql("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")
ORACLE = rf"""
WITH RECURSIVE src AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {_CRC} % 20 AS kind FROM conversations
), d AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
         CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM src, range(2) AS copies(c) WHERE kind <> 0 AND (c = 0 OR kind = 3)
), o AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 AS i, count(*) OVER (PARTITION BY conv_id) AS n,
         regexp_replace(text, '[ \t-\r]+$', '') AS bare FROM d
), f AS (
  SELECT *, left(role, 1) AS ini, CASE WHEN bare = '' THEN 'B' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'D'
         WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 'T' ELSE '-' END AS fault FROM o
), ins(g, h, s) AS (VALUES (0, 0, ''), (1, 1, ''), (2, 2, ''), (3, 3, ''), (0, 2, 'I'), (0, 3, 'II'), (1, 2, 'I'), (1, 3, 'II'), (2, 3, 'I'), (3, 2, 'I')),
mv(g, h, s, ini) AS (
  VALUES (0, 1, 'K', 's'), (0, 2, 'K', 'u'), (1, 2, 'K', 'u'), (3, 2, 'K', 'u'), (2, 3, 'K', 'a'), (0, 2, 'R', NULL), (1, 2, 'R', NULL), (2, 3, 'R', NULL), (3, 2, 'R', NULL),
         (0, 0, 'D', NULL), (1, 1, 'D', NULL), (2, 2, 'D', NULL), (3, 3, 'D', NULL)
), p(conv_id, i, g, cost, audit) AS (
  SELECT DISTINCT conv_id, 0::BIGINT, 0, 0, '' FROM f
  UNION ALL
  SELECT conv_id, i, g, b.cost, b.audit FROM (
    SELECT p.conv_id, p.i + 1 AS i, mv.h AS g,
           min({{'cost': p.cost + 3 * length(ins.s) + CASE mv.s WHEN 'D' THEN 4 WHEN 'R' THEN 3 ELSE 0 END + CASE WHEN f.fault = 'T' AND mv.s <> 'D' THEN 3 ELSE 0 END,
                'audit': p.audit || ins.s || mv.s}}) AS b
    FROM p JOIN f ON p.conv_id IS NOT DISTINCT FROM f.conv_id AND p.i = f.i JOIN ins ON ins.g = p.g
         JOIN mv ON mv.g = ins.h AND (mv.ini IS NULL OR mv.ini = f.ini) AND (mv.s = 'D' OR f.fault NOT IN ('B', 'D'))
    GROUP BY ALL)
), best AS (
  SELECT conv_id, min({{'cost': cost + 3 * length(t), 'audit': audit || t}}) AS b
  FROM p JOIN (VALUES (0, ''), (1, 'II'), (2, 'I'), (3, '')) AS tail(g, t) USING (g)
       JOIN (SELECT DISTINCT conv_id AS c, n FROM f) AS sizes ON p.conv_id IS NOT DISTINCT FROM c AND p.i = n GROUP BY conv_id
), e AS (
  SELECT conv_id, j, b.audit[j] AS ch FROM (SELECT conv_id, b, unnest(range(1, length(b.audit) + 1)) AS j FROM best)
), w AS (
  SELECT *, sum((ch <> 'I')::INT) OVER (PARTITION BY conv_id ORDER BY j) - 1 AS i, sum((ch <> 'D')::INT) OVER (PARTITION BY conv_id ORDER BY j) AS q FROM e
), y AS (
  SELECT w.*, f.role, f.text, f.ini FROM w LEFT JOIN f ON w.ch <> 'I' AND w.conv_id IS NOT DISTINCT FROM f.conv_id AND w.i = f.i WHERE w.ch <> 'D'
), z AS (SELECT *, max(CASE WHEN q = 1 AND ch = 'K' AND ini = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id) AS s FROM y),
rep AS (
  SELECT conv_id, string_agg(CASE WHEN ch = 'K' THEN role WHEN (q - s) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || coalesce(text, ''), chr(10) ORDER BY q) AS t FROM z GROUP BY conv_id
), adj AS (SELECT conv_id, fault, ini, lag(ini) OVER (PARTITION BY conv_id ORDER BY i) AS prev, turn, i FROM f),
st AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'B') AS blank, count(*) FILTER (fault = 'D') AS duplicate,
         count(*) FILTER (fault = 'T') AS truncated, count(*) FILTER (i > 0 AND prev || ini NOT IN ('su', 'ua', 'au')) AS illegal FROM adj GROUP BY conv_id
), ids AS (SELECT DISTINCT conv_id FROM conversations)
SELECT ids.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
       coalesce(illegal, 0)::BIGINT AS illegal, coalesce(b.cost, 0)::BIGINT AS cost, coalesce(b.audit, '') AS audit, sha256(coalesce(t, '')) AS repaired_sha256
FROM ids LEFT JOIN st ON ids.conv_id IS NOT DISTINCT FROM st.conv_id LEFT JOIN best ON ids.conv_id IS NOT DISTINCT FROM best.conv_id LEFT JOIN rep ON ids.conv_id IS NOT DISTINCT FROM rep.conv_id
"""
