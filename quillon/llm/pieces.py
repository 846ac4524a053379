"""SentencePiece encoding and decoding of merge-type vocabularies by an agenda of symbol pairs, in Arrow batches.

A text is normalised (blanks become the mark of a blank, one is put in front) and cut at the edges of runs of letters, or else before
marks of blanks, where the vocabulary has no piece that such a cut would divide; other vocabularies are encoded by whole texts. Each fragment starts as its characters; the agenda holds every adjacent pair whose concatenation is a piece, highest
score first and then leftmost; the first is merged, its new neighbours join the agenda, and entries
whose symbols are gone are passed over. Characters without a piece become their UTF-8 bytes' pieces, or the unknown piece where
the vocabulary has no bytes. That is the library's own rule, so ids equal its encode; `decoded` equals its decode.

Fragments that a task meets for the first time are encoded once and, with check=True, compared to the sentencepiece library's
ids before the Arrow batch that holds them leaves; a difference ends the task. A worker's cache of two bounded halves serves the frequent ones.

Defined results: a null text is empty and has the begin and end ids only; strings of control pieces inside a text are plain text, as in the library;
repeated rows and null or repeated ids are encoded each; texts are never cut off, and a run of n characters without a cut costs n log n. Models
whose normaliser changes texts otherwise are normalised by the library. Other columns of the input are ignored.
"""

from __future__ import annotations

import codecs
import functools
import heapq
import re
import unicodedata
from collections.abc import Iterator
from itertools import repeat
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.base import release_memory, small_batches
from quillon.llm.bpe import batches

#: What stands for a blank in pieces. Fixed by the format.
BLANK = "▁"
#: Encoded fragments of a worker's newer half of its cache; then that becomes the older half. Longer ones than LONG characters aren't kept.
CACHE, LONG = 250_000, 64

codecs.register_error("quillon-bytes", lambda e: ("�" * (e.end - e.start), e.end))


class PieceCodec:
    """One model file of merge type, ready to encode and decode."""

    def __init__(self, path: str, check: bool = True):
        import sentencepiece

        with open(path, "rb") as f:
            self.library = lib = sentencepiece.SentencePieceProcessor(model_proto=f.read())
        n = lib.vocab_size()
        names = [lib.id_to_piece(k) for k in range(n)]
        self.check = check
        self.begin, self.end, self.unknown = lib.bos_id(), lib.eos_id(), lib.unk_id()
        plain = [k for k in range(n) if not (lib.is_control(k) or lib.is_unknown(k) or lib.is_byte(k) or lib.is_unused(k))]
        if any(lib.is_unused(k) for k in range(n)):
            raise ValueError("vocabularies with unused pieces are not supported")
        self.ids = {names[k]: k for k in plain}
        #: Place of a piece in the agenda: the highest score first; the same score has the same place.
        places = {s: k for k, s in enumerate(sorted({-lib.get_score(k) for k in plain}))}
        self.place = {names[k]: places[-lib.get_score(k)] for k in plain}
        self.bytes = {int(names[k][3:5], 16): k for k in range(n) if lib.is_byte(k)}
        self.table = [name.replace(BLANK, " ") for name in names]
        for b, k in self.bytes.items():
            self.table[k] = chr(b) if b < 0x80 else chr(0xDC00 + b)
        self.controls = {k for k in range(n) if lib.is_control(k)}
        for k in self.controls:
            self.table[k] = ""
        if self.unknown >= 0:
            self.table[self.unknown] = lib.decode([self.unknown])
        self.cuts = next((c for c in self.possible_cuts() if not any(len(c.findall(x)) > 1 for x in self.ids if len(x) > 1)), None)
        probe = "a  b\n \tÅ ﬁ "
        #: Whether the model's normaliser does no more than to mark blanks.
        self.escapes = lib.normalize(probe) == BLANK + probe.replace(" ", BLANK)
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    @classmethod
    @functools.lru_cache(maxsize=1)
    def of_worker(cls, path: str, check: bool) -> PieceCodec:
        """One codec for all tasks that a Python worker runs."""
        return cls(path, check)

    def possible_cuts(self) -> list[re.Pattern]:
        """Ways to cut a text, the finest first: at the edges of runs of letters and before marks of blanks, or only there."""
        letters = "".join(sorted({c for x in self.ids for c in x if unicodedata.category(c)[0] in "LM"}))
        return [re.compile(f"{BLANK}*[{letters}]+|{BLANK}*[^{BLANK}{letters}]+|{BLANK}+"), re.compile(f"{BLANK}*[^{BLANK}]+|{BLANK}+")]

    def normalised(self, text: str) -> str:
        if not text:
            return ""
        return BLANK + text.replace(" ", BLANK) if self.escapes else self.library.normalize(text)

    def merged(self, symbols: list[str]) -> list[str]:
        """What stays of few symbols: the agenda is a list of places, and its least entry, leftmost first, is merged."""
        get, none = self.place.get, len(self.place)
        agenda = list(map(get, map(add, symbols, symbols[1:]), repeat(none)))
        while agenda and (first := min(agenda)) < none:
            k = agenda.index(first)
            symbols[k] += symbols.pop(k + 1)
            del agenda[k]
            if k:
                agenda[k - 1] = get(symbols[k - 1] + symbols[k], none)
            if k < len(agenda):
                agenda[k] = get(symbols[k] + symbols[k + 1], none)
        return symbols

    def merged_long(self, symbols: list[str]) -> list[str]:
        """The same of any number of symbols: the agenda is a heap, and entries whose symbols are gone are passed over."""
        get, n = self.place.get, len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        todo = [(p, k, pair) for k, pair in enumerate(map("".join, zip(symbols, symbols[1:], strict=False))) if (p := get(pair)) is not None]
        heapq.heapify(todo)
        while todo:
            _, k, made = heapq.heappop(todo)
            r = after[k]
            if not symbols[k] or r >= n or len(symbols[k]) + len(symbols[r]) != len(made):
                continue  # one of the two is gone or has grown
            symbols[k], symbols[r], after[k] = made, "", after[r]
            if after[k] < n:
                before[after[k]] = k
            for left in (before[k], k):
                if left >= 0 and after[left] < n and (p := get(pair := symbols[left] + symbols[after[left]])) is not None:
                    heapq.heappush(todo, (p, left, pair))
        return symbols

    def agenda(self, fragment: str) -> list[int]:
        """Ids of a fragment that has only its own characters as symbols."""
        symbols = list(fragment)
        symbols = self.merged(symbols) if len(symbols) <= LONG else self.merged_long(symbols)
        ids, out = self.ids, []
        for s in symbols:
            if s:
                k = ids.get(s)
                if k is not None:
                    out.append(k)
                elif self.bytes:
                    out += [self.bytes[b] for b in s.encode()]
                elif not out or out[-1] != self.unknown:  # neighbours without a piece are one unknown piece
                    out.append(self.unknown)
        return out

    def encode_many(self, texts: list[str]) -> list[bytes]:
        """Packed ids of each text with begin and end, little-endian unsigned 32-bit integers; new fragments are checked together."""
        if len(self.known) > CACHE:
            self.known, self.older = {}, self.known
        known, older, cuts = self.known, self.older, self.cuts
        first, last = np.array([self.begin], "<u4").tobytes(), np.array([self.end], "<u4").tobytes()
        split = [cuts.findall(x) if cuts else [x] * bool(x) for x in map(self.normalised, texts)]
        new = []
        for f in set().union(*split):
            if f not in known:
                if (packed := older.get(f)) is None:
                    new.append(f)
                else:
                    known[f] = packed
        made = list(map(self.agenda, new))
        if self.check and self.escapes:
            self.compare(new, made)
        for f, ids in zip(new, made, strict=True):
            known[f] = np.array(ids, "<u4").tobytes()
        out = [b"".join([first, *map(known.__getitem__, parts), last]) for parts in split]
        for f in new:
            if len(f) > LONG:
                del known[f]
        return out

    def compare(self, fragments: list[str], made: list[list[int]]) -> None:
        """Raise where the library gives other ids; a fragment after a blank's mark is a text to which the library adds that mark."""
        of = {f: ids for f, ids in zip(fragments, made, strict=True) if f[0] == BLANK and f != BLANK}
        for f, ids in zip(of, self.library.encode([f[1:].replace(BLANK, " ") for f in of], num_threads=1), strict=True):
            if ids != of[f]:
                raise AssertionError(f"the library encodes {f!r} as {ids}, the agenda as {of[f]}")

    def encode(self, text: str) -> np.ndarray:
        return np.frombuffer(self.encode_many([text])[0], "<u4")

    def decode(self, ids) -> str:
        """The text of ids as the library's decode gives it."""
        if not self.controls.isdisjoint(ids[1:-1]):  # bytes on two sides of a control piece don't meet
            edges = [-1, *(k for k, x in enumerate(ids) if x in self.controls), len(ids)]
            head, *rest = ("".join(map(self.table.__getitem__, ids[a + 1 : b])).encode("utf-8", "surrogateescape").decode("utf-8", "quillon-bytes") for a, b in zip(edges, edges[1:], strict=False) if b > a + 1)
            text = head + "".join(rest)
        else:
            text = "".join(map(self.table.__getitem__, ids))
        if text[:1] == " " and self.library.id_to_piece(next(k for k in ids if self.table[k]))[:1] == BLANK:
            text = text[1:]
        return text if text.isascii() else text.encode("utf-8", "surrogateescape").decode("utf-8", "quillon-bytes")


def encoded(docs: DataFrame, path: str, packed: bool = False, check: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, ids, decoded) of every text; packed: ids as little-endian unsigned 32-bit integers in one binary value, else an array."""
    schema = pa.schema([(id_col, pa.int64()), ("ids", pa.binary() if packed else pa.list_(pa.int32())), ("decoded", pa.string())])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = PieceCodec.of_worker(path, check)

        def rows():
            for part in parts:
                for at in range(0, part.num_rows, 64):
                    few = part.slice(at, 64)
                    for key, data in zip(few.column(0).to_pylist(), codec.encode_many(few.column(1).to_pylist()), strict=True):
                        ids = np.frombuffer(data, "<u4")
                        yield key, data if packed else ids.astype(np.int32), codec.decode(ids.tolist())

        yield from batches(rows(), schema, lambda r: 4 * len(r[1]) + len(r[2]))
        release_memory()

    small_batches(docs.sparkSession)
    kind = "binary" if packed else "array<int>"
    return docs.select(F.col(id_col).cast("long").alias(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("_t")).mapInArrow(run, f"`{id_col}` bigint, ids {kind}, decoded string")


def digest(made: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """What the contract asks for, of packed real outputs."""
    return made.select(
        id_col,
        F.expr("octet_length(ids) div 4").cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
