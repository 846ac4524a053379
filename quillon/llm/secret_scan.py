"""Secret scans: fixed patterns, and a likelihood ratio of two character Markov models.

`train` fits two first-order Markov models over characters, one of random strings and one of ordinary
identifiers, from labelled samples, and sets the threshold on samples held out. `found` looks at every
whole text: the base patterns' spans always stay; what they leave of a run of key characters, in pieces of
at least LEAST_RUN, is added as kind `random` where its log-likelihood ratio is over the threshold.

Random samples are what the base patterns find in a bounded sample of labelled documents, and strings drawn over the alphabets of
keys by a seeded generator; ordinary ones are names of the standard library's modules and classes, alone and joined, as identifiers
are, with words of a bounded sample of labelled good documents. Only the model is fitted on those samples; all texts are
scanned, in one pass without shuffle.

Defined results: a null or empty text has no spans; places are code points, ends exclusive; of two kinds
with one start the order of KINDS decides; repeated rows and rows without an id are scanned each. Other columns of the input are
ignored by `found` and kept by `redacted`.
"""

from __future__ import annotations

import importlib
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.base import SPACE_CLASS, release_memory, small_batches
from quillon.llm.bpe import batches

#: The contract's patterns. Fixed values.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # maximal runs, so as good as runs of which the short ones are dropped
KINDS = ("assign", "access", "hex", "random")
KEYWORDS = ("passw", "secret", "token", "apikey", "api_key")
#: A run of key characters that the models judge.
RUN = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
LEAST_RUN = 16
#: The bound on the labelled documents, and on their words, that the model of ordinary identifiers sees.
MAX_DOCS, MAX_WORDS = 2_000, 20_000
#: Modules of the standard library whose names are samples of ordinary identifiers.
LIBRARIES = ("argparse", "asyncio", "collections", "concurrent.futures", "csv", "datetime", "decimal", "email.message", "http.client", "inspect", "json", "logging", "os", "pathlib", "re", "shutil", "socket", "sqlite3", "ssl", "string", "subprocess", "tarfile", "threading", "unittest", "urllib.request", "xml.dom.minidom", "zipfile")
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
PLACE = {c: k for k, c in enumerate(ALPHABET)}


@dataclass(frozen=True)
class Model:
    """ratio[a, b]: log-likelihood ratio of character b after a; row len(ALPHABET) is the start."""

    ratio: np.ndarray
    threshold: float

    def score(self, run: str) -> float:
        """Mean log-likelihood ratio of a character; above 0 the string looks random."""
        x = [PLACE[c] for c in run]
        return float(self.ratio[[len(ALPHABET), *x[:-1]], x].mean())

    def random(self, run: str) -> bool:
        return self.score(run) > self.threshold


def counts(samples: list[str]) -> np.ndarray:
    out = np.full((len(ALPHABET) + 1, len(ALPHABET)), 0.1)
    for s in samples:
        x = [PLACE[c] for c in s]
        np.add.at(out, ([len(ALPHABET), *x[:-1]], x), 1)
    return np.log(out / out.sum(axis=1, keepdims=True))


def identifiers() -> list[str]:
    """Names that programs have: those of LIBRARIES and of their classes' members."""
    out: set[str] = set()
    for module in map(importlib.import_module, LIBRARIES):
        for name, value in vars(module).items():
            out.add(name)
            if isinstance(value, type):
                out.update(dir(value))
    return sorted(x for x in out if x.isascii() and all(c in PLACE for c in x))


def labelled_samples(words: list[str], secrets: tuple[str, ...] | list[str] = (), n: int = 12_000, seed: int = 7) -> tuple[list[str], list[str]]:
    """(random strings, ordinary identifiers) of 16 to 64 characters: secrets that the base patterns found, and drawn ones; names of
    programs, whole where they are long enough and joined with words of the corpus as identifiers are."""
    rng = random.Random(seed)
    lower, upper, digits = ALPHABET[:26], ALPHABET[26:52], ALPHABET[52:62]
    kinds = (lower + upper + digits, lower + digits, upper + digits, digits + "abcdef", lower + upper + digits + "+/", lower + upper + digits + "_-")
    fit_ = lambda x: sorted({s for s in x if LEAST_RUN <= len(s) <= 64 and all(c in PLACE for c in s)})
    keys = ["".join(rng.choices(rng.choice(kinds), k=rng.randint(LEAST_RUN, 64))) for _ in range(n)] + fit_(secrets)
    known = identifiers()
    parts_of = [p for name in known for p in re.findall("[A-Z]?[a-z]+|[A-Z]+(?![a-z])", name) if len(p) > 1]
    corpus = sorted({w for w in words if w and all(c in PLACE for c in w)})
    names = fit_(known)
    while len(names) < n:
        parts = [rng.choice(corpus if corpus and rng.random() < 0.5 else parts_of) for _ in range(rng.randint(1, 6))]
        style = rng.randrange(6)
        if style == 0:
            name = "_".join(parts).lower()
        elif style == 1:
            name = "-".join(parts).lower()
        elif style == 2:
            name = parts[0].lower() + "".join(p.capitalize() for p in parts[1:])
        elif style == 3:
            name = "_".join(parts).upper()
        elif style == 4:
            name = "/".join(parts)
        else:
            name = "".join(parts)
        if rng.random() < 0.2:
            name += rng.choice("_-/") + str(rng.randint(0, 99_999))
        if LEAST_RUN <= len(name) <= 64:
            names.append(name)
    return keys, names


def fit(keys: list[str], names: list[str], false_share: float = 0.0005) -> Model:
    """Two models from labelled samples; the threshold leaves at most false_share of the ordinary ones held out above it."""
    held_keys, held_names = keys[::4], names[::4]
    part = lambda x: [s for k, s in enumerate(x) if k % 4]
    ratio = counts(part(keys)) - counts(part(names))
    free = Model(ratio, 0.0)
    top = float(np.quantile([free.score(s) for s in held_names], 1 - false_share))
    low = float(np.quantile([free.score(s) for s in held_keys], 0.01))
    return Model(ratio, max(0.0, top, (top + low) / 2))


def base_secrets(text: str) -> list[str]:
    """What the base patterns find, an assignment by its value."""
    found = [m[2] for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_RUN] if any(k in text.lower() for k in KEYWORDS) else []
    return found + [m[0] for m in ACCESS.finditer(text) if len(m[0]) >= 20] + [m[0] for m in HEX.finditer(text)]


def train(docs: DataFrame, labels: DataFrame, max_docs: int = MAX_DOCS, max_words: int = MAX_WORDS) -> Model:
    """The models from at most max_docs good documents' words, and the base patterns' finds in as many labelled ones."""
    first = lambda df: df.where("doc_id IS NOT NULL").select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_docs)
    held = first(labels.where("quality = 1")).withColumn("good", F.lit(True)).unionByName(first(labels).withColumn("good", F.lit(False)))
    texts = docs.select("doc_id", "text").join(F.broadcast(held), "doc_id")  # at most 2 * max_docs ids

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            found = sorted({s for t in part.column(0).to_pylist() for s in base_secrets(t or "")})
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.string())], names=["w"])

    small_batches(docs.sparkSession)
    words = texts.where("good").select(F.explode(F.split("text", SPACE_CLASS)).alias("w")).where(F.col("w").rlike("^[A-Za-z]{2,32}$"))
    secrets = texts.where("NOT good").select("text").mapInArrow(run, "w string")
    kept = lambda df: [r["w"] for r in df.distinct().orderBy(F.xxhash64("w"), "w").limit(max_words).collect()]  # noqa: E731  at most max_words strings
    return fit(*labelled_samples(kept(words), kept(secrets)))


def pieces(start: int, end: int, base: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """What the sorted base spans leave of a run, in pieces of at least LEAST_RUN characters."""
    out, at = [], start
    for c, d in [*(x for x in base if x[0] < end and start < x[1]), (end, end)]:
        if c - at >= LEAST_RUN:
            out.append((at, c))
        at = max(at, d)
    return out


def spans(text: str, model: Model) -> list[tuple[int, int, str]]:
    """(start, end, kind) in order."""
    out: list[tuple[int, int, str]] = []
    lower = text.lower()
    if any(k in lower for k in KEYWORDS):
        out += [(*m.span(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(*m.span(), "access") for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    if max(map(len, text.split()), default=0) >= LEAST_RUN:  # patterns below hold no white space
        out += [(*m.span(), "hex") for m in HEX.finditer(text)]
        base = sorted(x[:2] for x in out)
        out += [(a, b, "random") for m in RUN.finditer(text) for a, b in pieces(*m.span(), base) if model.random(text[a:b])]
    return sorted(out, key=lambda x: (x[0], KINDS.index(x[2])))


def redact(text: str, held: list[tuple[int, int, str]], mark: str) -> str:
    out, at = [], 0
    for a, b, _ in sorted(held):
        if a >= at:
            out += (text[at:a], mark)
        at = max(at, b)
    return "".join([*out, text[at:]])


def _mapped(docs: DataFrame, model: Model, id_col: str, text_col: str, redacting: str | None) -> DataFrame:
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())]))
    schema = pa.schema([(id_col, pa.int64()), ("spans", kind)] + ([("text", pa.string())] if redacting is not None else []))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for part in parts:
                for key, cell in zip(part.column(0).to_pylist(), part.column(1), strict=True):
                    text = cell.as_py()
                    held = spans(text or "", model)
                    row = key, [{"start": a, "end": b, "kind": k} for a, b, k in held]
                    yield row if redacting is None else (*row, text if text is None else redact(text, held, redacting))

        yield from batches(rows(), schema, lambda r: 64 + 64 * len(r[1]) + (len(r[2] or "") if redacting is not None else 0))
        release_memory()

    out = f"`{id_col}` bigint, spans array<struct<start:bigint,end:bigint,kind:string>>" + (", text string" if redacting is not None else "")
    small_batches(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).alias("_t")).mapInArrow(run, out)


def found(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, spans) of every text."""
    return _mapped(docs, model, id_col, text_col, None)


def redacted(docs: DataFrame, model: Model, mark: str = "<SECRET>") -> DataFrame:
    """docs with every span of a secret replaced by mark; all columns and rows stay, n_chars follows.

    The whole row passes through the scan, so rows need no join and may repeat.
    """
    names, place = docs.columns, docs.columns.index("text")
    schema = docs.schema

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for at in range(0, part.num_rows, 512):
                piece = part.slice(at, 512)
                texts = [t if t is None else redact(t, spans(t, model), mark) for t in piece.column(place).to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array(texts, piece.schema.field(k).type) if k == place else c for k, c in enumerate(piece.columns)], schema=piece.schema)
        release_memory()

    small_batches(docs.sparkSession)
    out = docs.mapInArrow(run, schema)
    return out.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in names else out


def digest(made: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """What the contract asks for."""
    said = lambda x: F.array_join(F.transform(x, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    number = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    base = F.filter("spans", lambda s: s["kind"] != "random")
    return made.select(
        id_col,
        number("assign").alias("n_assign"),
        number("access").alias("n_access"),
        number("hex").alias("n_hex"),
        F.sha2(said(base).cast("binary"), 256).alias("base_sha256"),
        said(F.col("spans")).alias("spans"),
    )
