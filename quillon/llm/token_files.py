"""Token ids as flat binary files with 64-bit document offsets.

`write` sorts documents by id into range partitions; each task encodes its documents and streams one
shard to the shared folder:

    part-NNNNN-<attempt>.bin   token ids, unsigned little-endian, 2 bytes where the vocabulary fits, else 4
    part-NNNNN-<attempt>.idx   int64 pairs (doc_id, end offset in tokens inside the shard); NULL_ID stands for a null doc_id

A task names its shard by its attempt and renames it when it is whole, and the manifest lists what successful tasks
returned; a lost executor or a second attempt leaves at most an unlisted file. The driver sees one row
for each shard (number of tokens and documents) and turns them into bases by prefix sums, so an
offset in the whole sequence is base + offset in the shard. `read` maps the shards into memory where the
folder is a local or mounted path, and reads them as a stream elsewhere.

Texts are encoded with the tokenizers library. Words between single blanks or line breaks encode
independently of each other in byte-level BPE, so a bounded cache of words serves the frequent ones and the new ones
of many texts go to the library together; any other text goes to it as a whole.

Defined results: a null text is empty and holds the end id alone; a null doc_id stands first and is read back as null, and the
least 64-bit integer can't be a doc_id; equal doc_ids keep both documents, in order of their texts; an empty table gives no shard and no rows. Other columns of the input are ignored.
"""

from __future__ import annotations

import functools
import os
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.base import shuffle_partitions, small_batches
from quillon.llm.bpe import batches, byte_letters

#: Encoded words that a task keeps at most; then it starts anew.
CACHE = 700_000
#: Bytes of a shard that are held before they go to the file, and tokens read at once.
WRITE_AT, READ_AT = 4 << 20, 1 << 20
#: Marks that may follow a word's letters: a pre-token of their own.
MARKS = ".,;:!?"
#: What stands for a null id in the index, entries of it that are read at once, and bytes of text of a shard.
NULL_ID, INDEX_AT, SHARD_BYTES = -(1 << 63), 1 << 16, 256 << 20
#: Documents whose new words are encoded together.
ENCODE_AT = 512


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system and path of a Hadoop-style address."""
    if uri.startswith("file:/"):
        return pafs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return pafs.FileSystem.from_uri(uri)


class WordCachedEncoder:
    """The library's byte-level BPE with a cache of words; new words of many texts are encoded together."""

    def __init__(self, path: str, dtype: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core; the library's idle threads would spin on the others
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.dtype = dtype
        size = self.library.get_vocab_size(with_added_tokens=True)
        blank = self.library.id_to_token(self.library.encode(" ", add_special_tokens=False).ids[0])
        #: Flags by id: the token starts with a blank.
        self.opens = np.array([(self.library.id_to_token(k) or "").startswith(blank) for k in range(size)], bool)
        self.blank, self.letters = blank, byte_letters()
        self.tails: dict[str, bytes] = {}
        self.line = self.whole("\n")
        self.heads: dict[str, bytes] = {}
        self.later: dict[str, bytes] = {}

    @classmethod
    @functools.lru_cache(maxsize=2)
    def of_worker(cls, path: str, dtype: str) -> WordCachedEncoder:
        """One encoder for all tasks that a Python worker runs."""
        return cls(path, dtype)

    def whole(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()

    def _learn(self, words: list[str]) -> None:
        """Ids of words after a blank.

        Letters are one pre-token with the blank before them, and ASCII marks after them another one; such words go
        straight to the library's model. Others go through the whole library, where only the first token of each
        word starts with a blank.
        """
        tokenize, blank, letters, tails = self.library.model.tokenize, self.blank, self.letters, self.tails
        others = []
        for w in words:
            stem = w.rstrip(MARKS)
            if not stem.isalpha():
                others.append(w)
                continue
            ids = [t.id for t in tokenize(blank + (stem if stem.isascii() else stem.encode().decode("latin-1").translate(letters)))]
            packed = np.array(ids, self.dtype).tobytes()
            if len(stem) < len(w):
                tail = w[len(stem) :]
                if tail not in tails:
                    if len(tails) > 10_000:
                        tails.clear()
                    tails[tail] = self.whole(tail)
                packed += tails[tail]
            self.later[w] = packed
        words = others
        if not words:
            return
        ids = np.array(self.library.encode_batch_fast([" " + " ".join(words)], add_special_tokens=False)[0].ids, self.dtype)
        width, packed = ids.itemsize, ids.tobytes()
        at = [*(np.flatnonzero(self.opens[ids]) * width).tolist(), len(packed)]
        if len(at) != len(words) + 1:  # no vocabulary splits a blank off its word, but nothing else may pass here
            self.later.update((w, self.whole(" " + w)) for w in words)
        else:
            self.later.update((w, packed[a:b]) for w, a, b in zip(words, at, at[1:], strict=False))

    def encode_many(self, texts: list[str]) -> list[bytes]:
        """Packed ids of each text."""
        if len(self.later) > CACHE:
            self.later.clear()
        if len(self.heads) > CACHE:
            self.heads.clear()
        parsed: list[tuple[list[str], list[bytes | None], list[int]] | None] = []
        new: set[str] = set()
        get, head, long = self.later.get, self.heads.get, False
        for text in texts:
            words, blanks = text.split(), text.count(" ") + text.count("\n")
            # Single blanks and line breaks between words and no other white space: then each word stands alone, with the blank before it.
            if len(words) != blanks + 1 or sum(map(len, words)) + blanks != len(text) or any(s in text for s in self.special):
                parsed.append(None)
                continue
            packed = list(map(get, words))
            gaps = [k for k, ids in enumerate(packed) if ids is None]
            if gaps:
                unknown = [words[k] for k in gaps]
                new.update(unknown)
                long = long or max(map(len, unknown)) > 64
            parsed.append((words, packed, gaps))
        self._learn(sorted(new))
        out, later = [], self.later
        for text, known in zip(texts, parsed, strict=True):
            if known is None:
                out.append(self.whole(text))
                continue
            words, packed, gaps = known
            for k in gaps:
                packed[k] = later[words[k]]
            at = 0
            for k, line in enumerate(text.split("\n") if "\n" in text else [text]):
                first = words[at]  # without a blank before it
                ids = head(first)
                if ids is None:
                    ids = self.heads[first] = self.whole(first)
                packed[at] = self.line + ids if k else ids
                at += line.count(" ") + 1
            out.append(b"".join(packed))
        if long:
            for cache in (self.later, self.heads):
                for w in [w for w in cache if len(w) > 64]:
                    del cache[w]
        return out

    def encode(self, text: str) -> bytes:
        return self.encode_many([text])[0]


@dataclass(frozen=True)
class TokenFiles:
    """A written folder: shards in order, each with the number of tokens before it."""

    spark: SparkSession
    dtype: str
    shards: tuple[tuple[str, int, int, int], ...]  # stem, documents, tokens, base

    def manifest(self) -> DataFrame:
        return self.spark.createDataFrame([(k, *s) for k, s in enumerate(self.shards)], "shard int, stem string, n_docs long, n_tokens long, base long")

    def read(self) -> DataFrame:
        """(doc_id, start, n_tokens, ids_crc32) of every document, from the files."""
        dtype = self.dtype
        schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

        def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            def rows():
                for part in parts:
                    for stem, base in zip(part.column("stem").to_pylist(), part.column("base").to_pylist(), strict=True):
                        begin = 0
                        ids, index = opened(stem, dtype)
                        for doc_id, end in index:
                            crc = 0
                            for at in range(begin, end, READ_AT):
                                crc = zlib.crc32(ids(at, min(end, at + READ_AT)).astype("<u4").tobytes(), crc)
                            yield doc_id, base + begin, end - begin, crc
                            begin = end

            return batches(rows(), schema, lambda r: 32)

        shards = self.manifest().select("stem", "base")
        return shards.repartition(max(1, len(self.shards)), "stem").mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")

    def ids(self) -> DataFrame:
        """(doc_id, ids): the token ids themselves."""
        dtype = self.dtype
        schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int64()))])

        def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            def rows():
                for part in parts:
                    for stem in part.column("stem").to_pylist():
                        begin = 0
                        ids, index = opened(stem, dtype)
                        for doc_id, end in index:
                            yield doc_id, ids(begin, end).astype(np.int64)
                            begin = end

            return batches(rows(), schema, lambda r: 8 * len(r[1]))

        return self.manifest().select("stem").mapInArrow(run, "doc_id bigint, ids array<bigint>")


def opened(stem: str, dtype: str):
    """A shard's ids, as a function of (begin, end), and its (doc_id, end) pairs, read in slices."""
    files, path = filesystem(stem)
    if isinstance(files, pafs.LocalFileSystem):
        flat, index = np.memmap(f"{path}.bin", dtype, "r"), np.memmap(f"{path}.idx", "<i8", "r").reshape(-1, 2)
        return (lambda a, b: flat[a:b]), _pairs(len(index), lambda a, b: index[a:b])
    width, held, entries = np.dtype(dtype).itemsize, files.open_input_file(f"{path}.bin"), files.open_input_file(f"{path}.idx")
    return (lambda a, b: np.frombuffer(held.read_at((b - a) * width, a * width), dtype)), _pairs(entries.size() // 16, lambda a, b: np.frombuffer(entries.read_at((b - a) * 16, a * 16), "<i8").reshape(-1, 2))


def _pairs(n: int, read) -> Iterator[tuple[int | None, int]]:
    for at in range(0, n, INDEX_AT):
        for key, end in read(at, min(n, at + INDEX_AT)).tolist():
            yield None if key == NULL_ID else key, end


def write(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> TokenFiles:
    """Encode every text, append end_id, write the shards in ascending order of id_col."""
    from tokenizers import Tokenizer

    spark = docs.sparkSession
    small_batches(spark)
    dtype = "<u2" if Tokenizer.from_file(tokenizer).get_vocab_size(with_added_tokens=True) <= 1 << 16 else "<u4"

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        k = TaskContext.get().partitionId()
        encoder = WordCachedEncoder.of_worker(tokenizer, dtype)
        end = np.array([end_id], dtype).tobytes()
        stem = f"{folder}/part-{k:05d}-{uuid.uuid4().hex}"
        files, path = filesystem(stem)
        width, total, index, flat, held, size = np.dtype(dtype).itemsize, 0, [], None, [], 0
        n_docs = 0
        idx = None
        for part in (p.slice(at, ENCODE_AT) for p in parts for at in range(0, p.num_rows, ENCODE_AT)):
            for key, packed in zip(part.column(0).to_pylist(), encoder.encode_many(part.column(1).to_pylist()), strict=True):
                if flat is None:
                    files.create_dir(path.rpartition("/")[0], recursive=True)
                    flat, idx = files.open_output_stream(f"{path}.bin.tmp"), files.open_output_stream(f"{path}.idx.tmp")
                held += (packed, end)
                size += len(packed) + len(end)
                total += len(packed) // width + 1
                n_docs += 1
                if key == NULL_ID:
                    raise ValueError("the least 64-bit integer stands for a null id")
                index.append((NULL_ID if key is None else key, total))
                if size >= WRITE_AT or len(index) >= 1 << 16:
                    flat.write(b"".join(held))
                    idx.write(np.array(index, "<i8").tobytes())
                    held, index, size = [], [], 0
        if flat is None:
            return
        flat.write(b"".join(held))
        idx.write(np.array(index, "<i8").tobytes())
        flat.close()
        idx.close()
        for x in ("bin", "idx"):
            files.move(f"{path}.{x}.tmp", f"{path}.{x}")
        yield pa.RecordBatch.from_pydict({"k": pa.array([k], pa.int32()), "stem": [stem], "n_docs": [n_docs], "n_tokens": [total]})

    size = docs.agg(F.sum(F.octet_length(text_col))).head()[0] or 0
    shards = max(shuffle_partitions(spark), -(-size // SHARD_BYTES))
    ordered = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("t")).repartitionByRange(shards, "id").sortWithinPartitions("id", "t")
    written = sorted(ordered.mapInArrow(run, "k int, stem string, n_docs bigint, n_tokens bigint").collect())  # one row for each shard
    bases = np.concatenate([[0], np.cumsum([r["n_tokens"] for r in written])]).tolist()
    return TokenFiles(spark, dtype, tuple((r["stem"], r["n_docs"], r["n_tokens"], b) for r, b in zip(written, bases, strict=False)))
