"""BPE and token files against the tokenizers library."""

from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from quillon.llm import bpe, registry, token_files
from quillon.llm.base import shared_dir

ALPHABET = list("aAbΣσÉéßİıſK  \n\t\r\x0b\x0c\x1c\x1f\x85\u2003\u3000'stredlm0123½²٣.,!<|>/w中文🙂\u200d\ufeffe\u0301") + ["<|endoftext|>", "<|startoftext|>", "</w>", " the", "'ll ", "  ", "ing,"]


@pytest.fixture(scope="module")
def word():
    path = registry.vocabulary("word_bpe_49k.json")
    return bpe.ForcedBpe(path), Tokenizer.from_file(path)


def test_codec_equals_library(word):
    own, library = word
    rng = random.Random(11)
    for _ in range(4000):
        t = "".join(rng.choices(ALPHABET, k=rng.randint(0, 16)))
        ids = library.encode(t, add_special_tokens=False).ids
        assert own.encode(t.encode()).tolist() == ids, repr(t)
        assert own.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_cuts_are_certain(word):
    own, _ = word
    letters = own.letters
    text = "".join(letters[b] for b in "zq@#qxj~~^^`|{}".encode())
    parts = own.fragments(text)
    assert "".join(parts) == text and len(parts) > 1
    assert all((a[-1], b[0]) not in own.inside for a, b in zip(parts, parts[1:], strict=False))


def test_one_very_long_run(word):
    own, library = word
    t = "qz" * 30_000
    assert own.encode(t.encode()).tolist() == library.encode(t, add_special_tokens=False).ids


def test_frames_equal_library(docs, none, plain, word):
    _, library = word
    path = registry.vocabulary("word_bpe_49k.json")
    want = []
    for i, t in plain:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert sorted(map(tuple, bpe.digest(bpe.encoded(docs, path)).collect())) == sorted(want)
    assert bpe.encoded(none, path).count() == 0


def test_token_files_round_trip(spark, docs, none, plain):
    path = registry.vocabulary("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    made = token_files.write(docs, shared_dir(spark), path)
    start, want, ids_of = 0, [], {}
    for i, t in plain:
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 0]
        ids_of.setdefault(i, []).append(ids)
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(map(tuple, made.read().collect())) == sorted(want)
    assert all(r["ids"] in ids_of[r["doc_id"]] for r in made.ids().collect())
    bases = [r["base"] for r in made.manifest().orderBy("shard").collect()]
    assert bases == sorted(bases) and bases[0] == 0
    assert token_files.write(none, shared_dir(spark), path).read().count() == 0


def test_word_cache_equals_library():
    path = registry.vocabulary("byte_bpe_50k.json")
    own, library = token_files.WordCachedEncoder(path, "<u2"), Tokenizer.from_file(path)
    rng = random.Random(12)
    texts = ["".join(rng.choices(ALPHABET, k=rng.randint(0, 16))) for _ in range(4000)]
    for t, got in zip(texts, own.encode_many(texts), strict=True):
        assert np.frombuffer(got, "<u2").tolist() == library.encode(t, add_special_tokens=False).ids, repr(t)


def test_token_files_null_ids_slices_and_shards(spark, monkeypatch):
    path = registry.vocabulary("byte_bpe_50k.json")
    docs = spark.createDataFrame([(None, "b c"), (3, "x"), (None, None), (-(1 << 63) + 1, "y z")], "doc_id long, text string")
    monkeypatch.setattr(token_files, "SHARD_BYTES", 1)
    got = token_files.write(docs, shared_dir(spark), path).read().collect()
    assert sorted((r["doc_id"] is not None, r["doc_id"], r["n_tokens"]) for r in got if r["doc_id"] is not None) == [(True, -(1 << 63) + 1, 3), (True, 3, 2)]
    assert sorted(r["n_tokens"] for r in got if r["doc_id"] is None) == [1, 3] and min(got, key=lambda r: r["start"])["doc_id"] is None
    monkeypatch.setattr(token_files, "INDEX_AT", 2)
    assert [x for x in token_files._pairs(5, lambda a, b: np.array([[k, k + 1] for k in range(a, b)]))] == [(k, k + 1) for k in range(5)]
    with pytest.raises(Exception, match="least 64-bit"):
        token_files.write(spark.createDataFrame([(-(1 << 63), "b")], docs.schema), shared_dir(spark), path)


def test_words_without_a_certain_cut_pass_the_model_once(monkeypatch):
    """Their pairs are looked up together; only pieces with a cut are walked, and ids stay the library's."""
    path = registry.vocabulary("word_bpe_49k.json")
    walked, cut = [], bpe.ForcedBpe.fragments
    monkeypatch.setattr(bpe.ForcedBpe, "fragments", lambda self, letters: walked.append(letters) or cut(self, letters))
    codec, library = bpe.ForcedBpe(path), Tokenizer.from_file(path)
    for text in ("the Printing of words, it's plain 42", "\x01ab\x7fc \u0391\u03a3 \ufb01 e\u0301 <|endoftext|>end", "qzxjqv\u4e00\u4e01 z\u00ff\u0100"):
        assert codec.encode(text.encode()).tolist() == library.encode(text, add_special_tokens=False).ids
    assert not {"the", "printing", "of", "words", "it", "plain"} & set(walked)
