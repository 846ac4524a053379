"""Substring dedup with fixed-block anchors.

Every run of WINDOW words holds a whole block of BLOCK words whose place in its document is a multiple
of BLOCK (WINDOW >= 2 * BLOCK - 1). Those aligned blocks are the index; every rolling window of BLOCK
words is a probe. Where a probe meets an indexed block of another batch of documents, both sides extend
the hit: they exchange the digests of the WINDOW-word windows around it, and the batch with the smaller
doc_ids wins. Neighbouring windows that are found merge into maximal repeats.

Documents are dealt into batches that are ranges of doc_id, so "an earlier batch has it" means "a
document with a smaller doc_id has it", and only inside a batch do single documents count. Each batch
sends every distinct hash once, packed; a passage that stands in a third of all documents is one value for
each batch, never a pair of documents. A batch holds BATCH bytes of text on average, and there are as many buckets
of hashes, so both follow the input and not the cluster's settings.

Defined results: a null or empty text has no words and loses none; equal doc_ids don't cover each other,
as neither is smaller; a row without a doc_id loses no word and covers none; repeated words are handled as they stand; an
empty table gives an empty table. Blocks meet by 47 bits of their hash beside the bucket, which only adds candidates. Windows of different
batches are equal when 80 bits of a 128-bit digest of their words and the bucket from its other bits agree: among 10^13 different windows, and
10^7 buckets, the chance of one false match is below 10^-5. Inside a batch two rolling hashes of 64 bits must agree. Other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.base import small_batches
from quillon.llm.packed import by_key, inside, pack, rolling, unpack, word_hashes

WINDOW, BLOCK = 13, 7
#: Bytes of text in a batch of documents, on average.
BATCH = 6 << 20
_OTHER = 0xD6E8FEB86659FD93
_KEY = np.uint64((1 << 47) - 1)
_DIGEST = xxhash.xxh3_128_digest


def range_of(value: Column, bounds: list[int]) -> Column:
    """Number of bounds below value, found in two steps so that many bounds stay cheap."""
    if not bounds:
        return F.lit(0)
    step = max(1, int(len(bounds) ** 0.5))
    ladder = F.array(*[F.lit(int(x)).cast("long") for x in bounds[::step]])
    every = F.array(*[F.lit(int(x)).cast("long") for x in bounds])
    coarse = F.greatest(F.size(F.filter(ladder, lambda x: x < value)) - 1, F.lit(0)) * step
    return (coarse + F.size(F.filter(F.slice(every, coarse + 1, F.lit(step)), lambda x: x < value))).cast("int")


class Batch:
    """The words and windows of a batch of documents, one after the other."""

    def __init__(self, table: pa.Table):
        """Documents in order of their ids and texts, so that places are the same each time."""
        rows = sorted(zip(table.column("id").to_pylist(), table.column("t").to_pylist(), strict=True))
        texts = [t for _, t in rows]
        self.ids = np.array([i for i, _ in rows], np.int64)
        self.words = [t.split() for t in texts]
        self.sizes = np.array([len(w) for w in self.words], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)])
        self.hashes = word_hashes([w for words in self.words for w in words])
        self.doc = np.repeat(np.arange(len(texts)), self.sizes)
        self.place = np.arange(len(self.hashes)) - self.starts[self.doc]

    def windows(self, n: int, odd: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(places of the first words, hashes) of all windows of n words inside one document."""
        hashes = rolling(self.hashes, n, odd) if odd else rolling(self.hashes, n)
        own = self.place[: len(hashes)] + n <= self.sizes[self.doc[: len(hashes)]]
        at = np.flatnonzero(own)
        return at, hashes[at]

    def digests(self, at: np.ndarray, n: int) -> np.ndarray:
        """16 bytes for each window of n words from the places at, of their words as they stand."""
        words = [w for own in self.words for w in own]
        text = memoryview(b" ".join(words))
        edges = np.concatenate([[0], np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)])
        spans = zip(edges[at].tolist(), (edges[at + n] - 1).tolist(), strict=True)
        return np.frombuffer(b"".join([_DIGEST(text[a:b]) for a, b in spans]), np.uint8).reshape(-1, 16)


def _probes(table: pa.Table, buckets: int) -> pa.Table:
    """One batch's distinct rolling blocks, each with a flag: it is an aligned block here."""
    batch = Batch(table)
    at, hashes = batch.windows(BLOCK)
    aligned = (batch.place[at] % BLOCK == 0).astype(np.uint64)
    order = np.argsort(hashes, kind="stable")
    hashes, aligned = hashes[order], aligned[order]
    first = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]])) if len(hashes) else np.zeros(0, int)
    flags = np.maximum.reduceat(aligned, first) if len(first) else aligned
    hashes = hashes[first]
    bucket = ((hashes >> np.uint64(47)) % np.uint64(buckets)).astype(np.int64)
    values = ((hashes & _KEY) << np.uint64(1)) | flags
    rows = [(k, pack(values[p], 6)) for k, p in by_key(bucket)]
    return _rows(table, "k", rows)


def _rows(table: pa.Table, name: str, rows: list[tuple[int, bytes]]) -> pa.Table:
    b = table.column("b")[0].as_py() if table.num_rows else 0
    return pa.table({"b": pa.array([b] * len(rows), pa.int32()), name: pa.array([r[0] for r in rows], pa.int32()), "data": pa.array([r[1] for r in rows], pa.binary())})


def _gathered(table: pa.Table, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(values, batches) of one bucket, sorted by value and then batch."""
    parts = [unpack(x.as_py(), width) for x in table.column("data")]
    values = np.concatenate(parts)
    batches = np.repeat(np.array(table.column("b").to_pylist(), np.int64), [len(p) for p in parts])
    order = np.lexsort((batches, values >> np.uint64(1)))
    return values[order], batches[order]


def _answers(bucket: int, values: np.ndarray, batches: np.ndarray, width: int) -> pa.Table:
    rows = [(b, pack(values[p], width)) for b, p in by_key(batches)]
    return pa.table({"b": pa.array([r[0] for r in rows], pa.int32()), "k": pa.array([bucket] * len(rows), pa.int32()), "data": pa.array([r[1] for r in rows], pa.binary())})


def _anchors(table: pa.Table) -> pa.Table:
    """Blocks of one bucket that are indexed somewhere and stand in two batches, back to all batches that have them."""
    values, batches = _gathered(table, 6)
    keys = values >> np.uint64(1)
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    size = np.diff(np.concatenate([first, [len(keys)]]))
    hot = (size >= 2) & (np.maximum.reduceat(values & np.uint64(1), first) > 0)
    keep = np.repeat(hot, size)
    return _answers(table.column("k")[0].as_py(), keys[keep], batches[keep], 6)


def _candidates(docs: pa.Table, hits: pa.Table, buckets: int) -> pa.Table:
    """The distinct windows of one batch that hold an anchor."""
    if not docs.num_rows or not hits.num_rows:
        return pa.table({"b": pa.array([], pa.int32()), "k": pa.array([], pa.int32()), "data": pa.array([], pa.binary())})
    batch = Batch(docs)
    at, hashes = batch.windows(BLOCK)
    hot = np.zeros(len(batch.hashes) + 1, np.int64)
    # A hit's key is unique together with its bucket.
    bucket_of = ((hashes >> np.uint64(47)) % np.uint64(buckets)).astype(np.int64)
    held = np.sort(np.concatenate([unpack(d.as_py(), 6) * np.uint64(buckets) + np.uint64(k.as_py()) for k, d in zip(hits.column("k"), hits.column("data"), strict=True)]))
    hot[1:][at] = inside((hashes & _KEY) * np.uint64(buckets) + bucket_of.astype(np.uint64), held)
    hot = np.cumsum(hot)
    wide, keys = batch.windows(WINDOW)
    near = hot[wide + WINDOW - BLOCK + 1] > hot[wide]
    wide, keys = wide[near], keys[near]
    _, first = np.unique(keys, return_index=True)
    wide = np.sort(wide[first])
    digests = batch.digests(wide, WINDOW)
    halves = np.ascontiguousarray(digests).view("<u8")
    rows = []
    for k, p in by_key(((halves[:, 1] >> np.uint64(16)) % np.uint64(buckets)).astype(np.int64)):
        low = np.ascontiguousarray(digests[p, :10].T).tobytes()
        rows.append((k, pack(wide[p].astype(np.uint64), 4) + low))
    return _rows(docs, "k", rows)


def _later(table: pa.Table) -> pa.Table:
    """Places of windows of one bucket, back to all batches but the first that have them."""
    low, high, places, sizes = [], [], [], []
    for x in table.column("data"):
        data = x.as_py()
        n = len(data) // 14
        places.append(unpack(data[: 4 * n], 4))
        low.append(unpack(data[4 * n : 12 * n], 8))
        high.append(unpack(data[12 * n :], 2))
        sizes.append(n)
    batches = np.repeat(np.array(table.column("b").to_pylist(), np.int64), sizes)
    low, high, places = np.concatenate(low), np.concatenate(high), np.concatenate(places)
    order = np.lexsort((batches, high, low))
    low, high = low[order], high[order]
    again = order[np.concatenate([[False], (low[1:] == low[:-1]) & (high[1:] == high[:-1])])]
    return _answers(table.column("k")[0].as_py(), places[again], batches[again], 4)


def _removed(docs: pa.Table, hits: pa.Table) -> pa.Table:
    """Every document of one batch with its words' fate."""
    batch = Batch(docs)
    ids = batch.ids
    at, keys = batch.windows(WINDOW)
    found = np.zeros(len(at), bool)
    if hits.num_rows:
        held = np.concatenate([unpack(d.as_py(), 4) for d in hits.column("data")]).astype(np.int64)
        found = inside(keys, np.unique(keys[np.searchsorted(at, held)]))
    # Inside the batch the smallest doc_id that starts a window keeps it.
    if len(at):
        owner = ids[batch.doc[at]]
        other = rolling(batch.hashes, WINDOW, _OTHER)[at]
        order = np.lexsort((owner, other, keys))
        k, b, o = keys[order], other[order], owner[order]
        first = np.flatnonzero(np.concatenate([[True], (k[1:] != k[:-1]) | (b[1:] != b[:-1])]))
        least = np.repeat(o[first], np.diff(np.concatenate([first, [len(k)]])))
        found[order] |= o > least
    edge = np.zeros(len(batch.hashes) + 1, np.int64)
    hit = at[found]
    np.add.at(edge, hit, 1)
    np.add.at(edge, hit + WINDOW, -1)
    gone = np.cumsum(edge[:-1]) > 0
    kept, spans = [], []
    for k, words in enumerate(batch.words):
        flags = gone[batch.starts[k] : batch.starts[k + 1]]
        if not flags.any():
            kept.append(b" ".join(words))
            spans.append([])
            continue
        kept.append(b" ".join([w for w, f in zip(words, flags.tolist(), strict=True) if not f]))
        spans.append([{"start": int(a), "end": int(b)} for a, b in np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))).reshape(-1, 2)])
    return _result(pa.array(ids, pa.int64()), batch.sizes, spans, kept)


def _result(ids: pa.Array, sizes, spans: list, kept: list[bytes]) -> pa.Table:
    return pa.table(
        {
            "doc_id": ids,
            "n_words": pa.array(sizes, pa.int64()),
            "removed": pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
            "kept": pa.array(kept, pa.binary()).cast(pa.string()),
        }
    )


def _whole(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows without a doc_id: they keep all words."""
    for part in parts:
        words = [t.split() for t in part.column(0).to_pylist()]
        yield from _result(pa.nulls(len(words), pa.int64()), [len(w) for w in words], [[]] * len(words), [b" ".join(w) for w in words]).to_batches()


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, removed [(start, end) in words], kept): maximal repeats of earlier documents, and the text of the other words."""
    spark = docs.sparkSession
    small_batches(spark)
    every = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("t"))
    texts = every.where("id IS NOT NULL")
    n = max(1, -(-(texts.agg(F.sum(F.octet_length("t"))).first()[0] or 0) // BATCH))
    bounds = texts.agg(F.percentile_approx("id", [k / n for k in range(1, n)], 10 * n)).first()[0] if n > 1 else []  # n numbers
    dealt = texts.withColumn("b", range_of(F.col("id"), sorted(set(bounds or []))))
    by_batch = dealt.groupBy("b")
    packed = "b int, k int, data binary"
    probes = by_batch.applyInArrow(lambda t: _probes(t, n), packed)
    anchors = probes.groupBy("k").applyInArrow(_anchors, packed)
    windows = by_batch.cogroup(anchors.groupBy("b")).applyInArrow(lambda d, h: _candidates(d, h, n), packed)
    later = windows.groupBy("k").applyInArrow(_later, packed)
    result = "doc_id bigint, n_words bigint, removed array<struct<start:bigint,end:bigint>>, kept string"
    judged = by_batch.cogroup(later.groupBy("b")).applyInArrow(_removed, result)
    return judged.unionByName(every.where("id IS NULL").select("t").mapInArrow(_whole, result))


def digest(made: DataFrame) -> DataFrame:
    """What the contract asks for."""
    return made.select(
        "doc_id",
        "n_words",
        F.aggregate("removed", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"]).alias("n_removed"),
        F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"),
    )


ORACLE = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
p AS (SELECT doc_id, i, array_to_string(w[i : i + 12], ' ') AS gram FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) >= 13)),
m AS (SELECT gram, min(doc_id) AS least FROM p GROUP BY gram),
r AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS k FROM p JOIN m USING (gram) WHERE p.doc_id > m.least),
x AS (SELECT doc_id, k, w[k] AS word FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS k FROM d)),
y AS (SELECT x.doc_id, count(r.k)::BIGINT AS n_removed, coalesce(string_agg(CASE WHEN r.k IS NULL THEN word END, ' ' ORDER BY x.k), '') AS kept
      FROM x LEFT JOIN r ON x.doc_id = r.doc_id AND x.k = r.k GROUP BY x.doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(y.n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(y.kept, '')) AS kept_sha256
FROM d LEFT JOIN y USING (doc_id)
"""
