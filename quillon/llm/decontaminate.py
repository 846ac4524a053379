"""Benchmark decontamination with a broadcast set of normalised n-grams.

Windows of n words of all benchmark items (an item of fewer words is one window) are hashed; the distinct ones are
one sorted array with a table of bits before it, which lets through few windows that are none of them. That set is broadcast
only where the benchmark's texts hold at most MAX_BENCHMARK_BYTES, which is checked first (built, it takes about four times
its texts: 8 bytes of hash, 20 of places and lists for each distinct window, and the normalised text). A larger benchmark is cut into blocks of
that size, built once and written to the shared folder; the documents' words are hashed once, and every block is read once for each slice of
SLICE words of documents. A task scans the windows of all words of its documents with a rolling hash, verifies each hit word by word and
marks the words it covers. No shuffle of documents.

Defined results: null and empty texts and items have no words and no hits; an item given twice counts by
item_id, and all items without an id count as one, whose name the lists give as null; rows without a doc_id are judged as the others;
windows never cross documents; texts are scanned whole, whatever their length. Other columns of
the input are ignored by `marked` and kept by `clean`.
"""

from __future__ import annotations

import pickle
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.base import release_memory, shared_dir, small_batches
from quillon.llm.bpe import batches
from quillon.llm.packed import mix, word_hashes
from quillon.llm.token_files import filesystem

N = 10
#: A benchmark of more bytes is scanned in blocks of items of at most so many bytes.
MAX_BENCHMARK_BYTES = 8 << 20
#: Words of documents that are scanned at once, and where every slice reads the blocks of a large benchmark.
SCAN_AT, SLICE = 1 << 18, 1 << 21
#: A-Z become a-z, ASCII other than letters and digits becomes a blank; all other bytes are parts of words.
_TABLE = bytes((b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32) for b in range(256))
#: A word in a text that is not lower-cased yet.
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_TABLE).split()


def windows(x: np.ndarray, sizes: list[int]) -> Iterator[tuple[int, np.ndarray]]:
    """(size, hashes of all windows of so many neighbours of x) for sizes in ascending order."""
    out = np.zeros(len(x), np.uint64)
    for k in range(max(sizes, default=0)):
        out = out[: max(0, len(x) - k)] * _MULTIPLIER + x[k:]
        if k + 1 in sizes:
            yield k + 1, mix(out)


class Grams:
    """The windows of benchmark items."""

    def __init__(self, items: list[tuple[str | None, bytes]], n: int = N):
        names = sorted({i for i, _ in items}, key=_name)
        number = {name: k for k, name in enumerate(names)}
        self.names = names
        words = [words_of(t) for _, t in items]
        lengths = np.array([len(w) for w in words], np.int64)
        starts = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
        x = word_hashes([w for own in words for w in own])
        self.text = b" ".join(b" ".join(w) for w in words if w) + b" "
        spaces = np.flatnonzero(np.frombuffer(self.text, np.uint8) == 32) if len(x) else np.zeros(0, np.int64)
        self.edges = np.concatenate([[-1], spaces]).astype(np.int32 if len(self.text) < 1 << 31 else np.int64)
        place = np.arange(len(x)) - np.repeat(starts[:-1], lengths)
        item = np.repeat(np.array([number[i] for i, _ in items], np.int32), lengths)
        whole = np.repeat(lengths, lengths)
        size = np.minimum(n, whole)
        self.tables = []
        for length, hashes in windows(x, sorted(set(size.tolist()))):
            at = np.flatnonzero((size == length)[: len(hashes)] & (place + length <= whole)[: len(hashes)])
            self.tables.append(self._table(length, x, hashes[at], at, item[at]))

    @staticmethod
    def _table(length: int, x: np.ndarray, hashes: np.ndarray, at: np.ndarray, item: np.ndarray):
        """(length, bits, hashes of distinct windows, a place of each, number of its list of items, lists' starts, lists)."""
        order = np.lexsort((item, hashes))
        hashes, at, item = hashes[order], at[order], item[order]
        fresh = np.concatenate([[True], hashes[1:] != hashes[:-1]])
        for k in range(length):  # other words with the same hash are a window of their own
            fresh[1:] |= x[at[1:] + k] != x[at[:-1] + k]
        once = fresh | np.concatenate([[True], item[1:] != item[:-1]])
        window = np.cumsum(fresh)[once] - 1
        members = item[once]
        first = np.flatnonzero(np.concatenate([[True], window[1:] != window[:-1]]))
        lists: dict[bytes, int] = {}
        ends = [*first[1:].tolist(), len(members)]
        of = np.fromiter((lists.setdefault(members[a:b].tobytes(), len(lists)) for a, b in zip(first.tolist(), ends, strict=True)), np.int32, len(first))
        parts = [np.frombuffer(b, np.int32) for b in lists]
        bits = np.zeros(1 << max(12, int(8 * len(first)).bit_length()), bool) if len(first) < 1 << 24 else None
        if bits is not None:
            bits[(hashes[fresh] & np.uint64(len(bits) - 1)).astype(np.int64)] = True
        return length, bits, hashes[fresh], at[fresh].astype(np.int32), of, np.concatenate([[0], np.cumsum([len(p) for p in parts])]), np.concatenate([*parts, np.zeros(0, np.int32)])

    def window(self, at: int, length: int) -> bytes:
        return self.text[self.edges[at] + 1 : self.edges[at + length]]

    def scan(self, hashed: dict[int, np.ndarray], words: list[bytes], inside: np.ndarray, edge: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """hashed: windows' hashes by size; inside: words left in the document from each place. Counts hits' starts and ends in edge;
        gives (places, numbers of lists) of hits for each size, and the lists through `listed`."""
        for k, (length, bits, hashes, at, of, _, _) in enumerate(self.tables):
            found = hashed[length]
            maybe = np.flatnonzero(bits[(found & np.uint64(len(bits) - 1)).astype(np.int64)]) if bits is not None else np.arange(len(found))
            maybe = maybe[inside[maybe] >= length]
            left, right = np.searchsorted(hashes, found[maybe], "left"), np.searchsorted(hashes, found[maybe], "right")
            many = right - left
            maybe, spot = np.repeat(maybe, many), np.arange(many.sum()) + np.repeat(left - np.cumsum(many) + many, many)
            true = np.fromiter((b" ".join(words[p : p + length]) == self.window(w, length) for p, w in zip(maybe.tolist(), at[spot].tolist(), strict=True)), bool, len(maybe))
            maybe, spot = maybe[true], spot[true]
            np.add.at(edge, maybe, 1)
            np.add.at(edge, maybe + length, -1)
            yield k, maybe, of[spot]

    def listed(self, table: int, number: int) -> list[str | None]:
        starts, members = self.tables[table][5:]
        return [self.names[m] for m in members[starts[number] : starts[number + 1]].tolist()]


def _name(item: str | None) -> tuple[bool, str]:
    return item is None, item or ""


class _Blocks:
    """The benchmark's Grams, block by block, inside a task."""

    def __init__(self, held=None, files: list[str] | None = None, sizes: tuple[int, ...] = ()):
        self.held, self.files, self.sizes = held, files, list(sizes)

    def lengths(self) -> list[int]:
        return self.sizes if self.held is None else [t[0] for t in self.held.value.tables]

    def __iter__(self) -> Iterator[Grams]:
        if self.held is not None:
            yield self.held.value
        for path in self.files or ():
            files, name = filesystem(path)
            with files.open_input_stream(name) as src:
                yield pickle.loads(src.read())  # noqa: S301  written by `save` below

    @property
    def at_once(self) -> int:
        return SCAN_AT if self.held is not None else SLICE


def _blocks(benchmark: DataFrame, n: int, most: int) -> _Blocks:
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), F.coalesce("text", F.lit("")).alias("text"))
    size = items.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    if size <= most:
        grams = Grams([(r["item"], r["text"].encode()) for r in items.toLocalIterator()], n)  # at most `most` bytes
        return _Blocks(held=benchmark.sparkSession.sparkContext.broadcast(grams))
    folder, parts = shared_dir(benchmark.sparkSession), -(-2 * size // most)
    numbered = items.withColumn("block", F.pmod(F.xxhash64("item", "text"), F.lit(parts)).cast("int"))

    def save(group: pa.Table) -> pa.Table:
        grams = Grams([(a, b.encode()) for a, b in zip(group.column("item").to_pylist(), group.column("text").to_pylist(), strict=True)], n)
        path = f"{folder}/{group.column('block')[0].as_py():06d}-{uuid.uuid4().hex}.grams"
        files, name = filesystem(path)
        files.create_dir(name.rpartition("/")[0], recursive=True)
        with files.open_output_stream(f"{name}.tmp") as out:
            out.write(pickle.dumps(grams, protocol=5))
        files.move(f"{name}.tmp", name)
        return pa.table({"file": [path], "sizes": pa.array([[t[0] for t in grams.tables]], pa.list_(pa.int32()))})

    written = numbered.groupBy("block").applyInArrow(save, "file string, sizes array<int>").collect()  # one row for each block
    return _Blocks(files=sorted(r["file"] for r in written), sizes=tuple(sorted({x for r in written for x in r["sizes"]})))


def _judged(blocks: _Blocks, keys: list, words: list[list[bytes]]) -> Iterator[tuple]:
    """(key, number of words, spans, items) of each document, over all blocks of the benchmark."""
    sizes = np.array([len(w) for w in words], np.int64)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    flat = [w for own in words for w in own]
    inside = np.repeat(starts[1:], sizes) - np.arange(starts[-1])
    hashed = dict(windows(word_hashes(flat), blocks.lengths()))
    edge = np.zeros(starts[-1] + 1, np.int64)
    items: dict[int, set] = {}
    for grams in blocks:
        for table, places, lists in grams.scan(hashed, flat, inside, edge):
            if len(places):
                docs = np.searchsorted(starts, places, "right") - 1
                for doc, number in set(zip(docs.tolist(), lists.tolist(), strict=True)):
                    items.setdefault(doc, set()).update(grams.listed(table, number))
    covered = np.cumsum(edge[:-1]) > 0
    for k, key in enumerate(keys):
        spans = []
        if k in items:
            edges = np.flatnonzero(np.diff(np.concatenate([[0], covered[starts[k] : starts[k + 1]].astype(np.int8), [0]])))
            spans = [{"start": int(a), "end": int(b)} for a, b in edges.reshape(-1, 2)]
        yield key, len(words[k]), spans, sorted(items.get(k, ()), key=_name)


def marked(docs: DataFrame, benchmark: DataFrame, n: int = N, id_col: str = "doc_id", text_col: str = "text", most: int = MAX_BENCHMARK_BYTES) -> DataFrame:
    """(id_col, n_words, spans [(start, end) in words], items): merged spans of hit words and ids of items with windows there."""
    blocks = _blocks(benchmark, n, most)
    schema = pa.schema([(id_col, pa.int64()), ("n_words", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("items", pa.list_(pa.string()))])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            keys, words, held = [], [], 0
            for part in parts:
                for key, text in zip(part.column(0).to_pylist(), part.column(1), strict=True):
                    keys.append(key)
                    words.append(words_of(text.as_py()))
                    held += len(words[-1])
                    if held >= blocks.at_once:
                        yield from _judged(blocks, keys, words)
                        keys, words, held = [], [], 0
            if keys:
                yield from _judged(blocks, keys, words)

        yield from batches(rows(), schema, lambda r: 32 * len(r[2]) + 64)
        release_memory()

    small_batches(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias(id_col), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("_t")).mapInArrow(run, f"`{id_col}` bigint, n_words bigint, spans array<struct<start:bigint,end:bigint>>, items array<string>")


def digest(made: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """What the contract asks for."""
    return made.select(
        id_col,
        "n_words",
        F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"]).alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )


def clean(docs: DataFrame, benchmark: DataFrame, remove: str = "documents", n: int = N, most: int = MAX_BENCHMARK_BYTES) -> DataFrame:
    """docs without contaminated documents, or (remove="spans") with the hit words taken out of their texts.

    A removed span goes with the separators up to the next word; a text without hits stays byte for byte, a null
    stays null, and n_chars follows where the table has it. Whole rows pass through the scan, so there is no
    join, rows may repeat and other columns stay as they are.
    """
    blocks = _blocks(benchmark, n, most)
    place, schema = docs.columns.index("text"), docs.schema

    def slices(parts: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[pa.RecordBatch], list, list]]:
        """Batches until they hold enough words, their texts and their words."""
        own, texts, words = [], [], []
        for part in (p.slice(at, 512) for p in parts for at in range(0, p.num_rows, 512)):
            own.append(part)
            texts.append(part.column(place).to_pylist())
            words += [words_of((t or "").encode()) for t in texts[-1]]
            if blocks.held is not None or sum(map(len, words)) >= blocks.at_once:
                yield own, texts, words
                own, texts, words = [], [], []
        if own:
            yield own, texts, words

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own, held, words in slices(parts):
            judged = [spans for _, _, spans, _ in _judged(blocks, list(range(len(words))), words)]
            at = 0
            for part, texts in zip(own, held, strict=True):
                yield cut(part, texts, judged[at : at + len(texts)])
                at += len(texts)
        release_memory()

    def cut(part: pa.RecordBatch, texts: list, judged: list) -> pa.RecordBatch:
        found = [(k, spans) for k, spans in enumerate(judged) if spans]
        if remove == "documents":
            hit = {k for k, _ in found}
            return part if not hit else part.filter(pa.array([k not in hit for k in range(len(texts))]))
        for k, spans in found:
            places = [m.span() for m in _WORD.finditer(texts[k])]
            edges = [*(a for a, _ in places), len(texts[k])]
            out, at = [], 0
            for s in spans:
                out.append(texts[k][at : edges[s["start"]]])
                at = edges[s["end"]]
            texts[k] = "".join([*out, texts[k][at:]])
        return pa.RecordBatch.from_arrays([pa.array(texts, part.schema.field(k).type) if k == place else c for k, c in enumerate(part.columns)], schema=part.schema)

    small_batches(docs.sparkSession)
    out = docs.mapInArrow(run, schema)
    return out.withColumn("n_chars", F.char_length("text").cast("long")) if remove == "spans" and "n_chars" in docs.columns else out


ORACLE = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
b AS (SELECT item_id, list_filter(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
g AS (SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') AS gram
      FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM g),
p AS (SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS gram
      FROM (SELECT d.doc_id, d.w, s.n, unnest(range(1, len(d.w) - s.n + 2)) AS i FROM d, sizes s WHERE len(d.w) >= s.n)),
h AS (SELECT p.doc_id, p.i, g.n, g.item_id FROM p JOIN g ON p.n = g.n AND p.gram = g.gram),
c AS (SELECT doc_id, count(DISTINCT k)::BIGINT AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM h) GROUP BY doc_id),
it AS (SELECT doc_id, count(*)::BIGINT AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM h) GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(c.n_hit, 0)::BIGINT AS n_hit, coalesce(it.n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(it.items, '')) AS items_sha256, coalesce(c.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN it USING (doc_id)
"""
