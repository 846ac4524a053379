"""BPE encoding by forced boundaries, and decoding.

A pair of bytes that stands inside no vocabulary token can't be covered by any merge, so a cut between
its two bytes is certain. `ForcedBpe` cuts each pre-token at all such pairs, encodes the fragments
independently and concatenates their ids. White space is dropped by the tokenizer's own pre-tokenizer,
so a text's words are independent too, and a bounded cache of encoded words serves the frequent ones.

`encoded` gives real outputs, (id, ids, decoded); results equal the tokenizers library's encode with
add_special_tokens=False and decode with skip_special_tokens=False, for word-level BPE files with an
end-of-word suffix, NFC, white space and lower-case normalisers and no decoder.

Defined results: a null text is empty and has no ids; strings of special tokens inside a text are those
tokens, as in the library; repeated rows and rows without an id are encoded each; texts are never cut off. Fragments are encoded
in time n log n by the library's model, so one very long run of letters does not stall a task. Other
columns of the input are ignored.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator
from struct import pack

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers.models import BPE

from quillon.llm.base import release_memory, small_batches

#: Encoded words that a task keeps at most; then it starts anew.
CACHE = 400_000
#: The pre-tokenizer's pattern by which a run of letters is one piece.
ONE_RUN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Rows in one Arrow batch that goes back to the JVM, or fewer where they hold this many bytes.
ROWS_OUT, BYTES_OUT = 512, 8 << 20


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in byte-level vocabularies: printable ones for themselves, the others from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(others)}


class ForcedBpe:
    """One tokenizer file, ready to encode and decode."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.suffix = model["end_of_word_suffix"] or ""
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.last = BPE(vocab=model["vocab"], merges=merges, end_of_word_suffix=self.suffix or None)
        self.inner = BPE(vocab=model["vocab"], merges=merges)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = [""] * (1 + max([*model["vocab"].values(), *self.special.values()]))
        for token, k in [*model["vocab"].items(), *self.special.items()]:
            self.tokens[k] = token
        self.letters = byte_letters()
        self.inside = set()
        for token in model["vocab"]:
            body = token.removesuffix(self.suffix) if self.suffix else token
            self.inside.update(zip(body, body[1:], strict=False))
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.pieces = regex.compile(split["pattern"]["Regex"])
        self.specials = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")")
        self.space = regex.compile(r"\s+")
        self.one_run = split["pattern"]["Regex"] == ONE_RUN
        self.words: dict[bytes, bytes] = {}
        self.parts: dict[str, bytes] = {}

    def fragments(self, letters: str) -> list[str]:
        """The pieces between certain cuts."""
        out, start = [], 0
        for k, pair in enumerate(zip(letters, letters[1:], strict=False), 1):
            if pair not in self.inside:
                out.append(letters[start:k])
                start = k
        out.append(letters[start:])
        return out

    def piece(self, text: str) -> bytes:
        """Ids of one pre-token, as little-endian unsigned 32-bit integers."""
        packed = self.parts.get(text)
        if packed is None:
            letters = text if text.isascii() and text.isprintable() else "".join(map(self.letters.__getitem__, text.encode()))
            if self.inside.issuperset(zip(letters, letters[1:], strict=False)):  # no certain cut, as in most
                ids = [t.id for t in self.last.tokenize(letters)]
            else:
                *head, tail = self.fragments(letters)
                ids = [t.id for x in head for t in self.inner.tokenize(x)] + [t.id for t in self.last.tokenize(tail)]
            packed = pack(f"<{len(ids)}I", *ids)
            if len(self.parts) >= CACHE:
                self.parts.clear()
            if len(text) <= 64:
                self.parts[text] = packed
        return packed

    def word(self, word: bytes) -> bytes:
        """Ids of what stands between white space, as little-endian unsigned 32-bit integers."""
        ids: list[bytes] = []
        text = word.decode("utf-8", "replace")
        for k, part in enumerate(self.specials.split(text) if "<|" in text else [text]):
            if k % 2:
                ids.append(pack("<I", self.special[part]))
                continue
            if not part.isascii():
                part = self.space.sub(" ", unicodedata.normalize("NFC", part))
                part = "".join(c.lower() for c in part) if "Σ" in part else part.lower()
            else:
                part = part.lower()
                if self.one_run and part.isalpha():
                    ids.append(self.piece(part))
                    continue
            ids += map(self.piece, self.pieces.findall(part))
        packed = ids[0] if len(ids) == 1 else b"".join(ids)
        if len(self.words) >= CACHE:
            self.words.clear()
        if len(word) <= 64:
            self.words[word] = packed
        return packed

    def encode(self, text: bytes) -> np.ndarray:
        known, word = self.words.get, self.word
        return np.frombuffer(b"".join([known(w) or word(w) for w in text.split()]), "<u4")

    def decode(self, ids) -> str:
        """Tokens joined by a space: what a tokenizer without decoder gives."""
        return " ".join(map(self.tokens.__getitem__, ids))


def batches(rows: Iterator[tuple], schema: pa.Schema, weight) -> Iterator[pa.RecordBatch]:
    """Record batches of bounded size from rows."""
    held: list[tuple] = []
    size = 0
    for row in rows:
        held.append(row)
        size += weight(row)
        if len(held) >= ROWS_OUT or size >= BYTES_OUT:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)


def encoded(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, ids, decoded) of every text."""
    schema = pa.schema([(id_col, pa.int64()), ("ids", pa.list_(pa.int32())), ("decoded", pa.string())])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = ForcedBpe(path)  # for one task: a worker that lives on doesn't hold its caches

        def rows():
            for part in parts:
                for key, text in zip(part.column(0).to_pylist(), part.column(1), strict=True):
                    ids = codec.encode(text.as_py() or b"")
                    yield key, ids.astype(np.int32), codec.decode(ids.tolist())

        yield from batches(rows(), schema, lambda r: 4 * len(r[1]) + len(r[2]))
        del codec, rows
        release_memory()

    small_batches(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias(id_col), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("_t")).mapInArrow(run, f"`{id_col}` bigint, ids array<int>, decoded string")


def digest(made: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """What the contract asks for, of real outputs."""
    return made.select(
        id_col,
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
