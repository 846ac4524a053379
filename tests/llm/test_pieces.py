"""The agenda of symbol pairs against the sentencepiece library."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest
import sentencepiece

from quillon.llm import pieces, registry

ALPHABET = list("aAbΣσÉéßİıſK  \n\t\r\x0b\x0c\x1c\x00\x85 　'stredlm0123½²٣.,!<|>/w中文क्षि🙂‍﻿é▁") + ["</s>", "<s>", "<unk>", "<0x0A>", " the", "'ll ", "  ", "    ", "ing,", "▁▁"]


@pytest.fixture(scope="module")
def codec():
    path = registry.vocabulary("piece_bpe_32k.model")
    return pieces.PieceCodec(path), sentencepiece.SentencePieceProcessor(model_file=path)


def test_codec_equals_library(codec):
    own, library = codec
    rng = random.Random(21)
    for _ in range(6000):
        t = "".join(rng.choices(ALPHABET, k=rng.randint(0, 24)))
        ids = library.encode(t, add_bos=True, add_eos=True)
        assert own.encode(t).tolist() == ids, repr(t)
        assert own.decode(ids) == library.decode(ids), repr(t)
        ids = [rng.randrange(32000) if rng.random() < 0.5 else rng.randrange(259) for _ in range(rng.randint(0, 12))]
        assert own.decode(ids) == library.decode(ids), ids


def test_list_and_heap_agree(codec):
    own, _ = codec
    rng = random.Random(22)
    for _ in range(3000):
        symbols = rng.choices(ALPHABET[:40] + list("theinganderon"), k=rng.randint(1, 40))
        symbols = list("".join(symbols))
        assert own.merged(list(symbols)) == [s for s in own.merged_long(list(symbols)) if s]


def test_cuts_divide_no_piece(codec):
    own, _ = codec
    assert own.cuts is not None and all(len(own.cuts.findall(x)) == 1 for x in own.ids)


def test_long_runs(codec):
    own, library = codec
    for t in ("qz" * 30_000, " " * 30_000 + "a", "\n" * 20_000, "é" * 20_001):
        assert own.encode(t).tolist() == library.encode(t, add_bos=True, add_eos=True)


def test_a_difference_ends_the_task(codec):
    own, _ = codec
    with pytest.raises(AssertionError):
        own.compare(["▁the"], [[1, 2]])


def test_frames_equal_library(docs, none, plain, codec):
    _, library = codec
    path = registry.vocabulary("piece_bpe_32k.model")
    want, ids_of = [], {}
    for i, t in plain:
        ids = library.encode(t or "", add_bos=True, add_eos=True)
        ids_of.setdefault(i, []).append(ids)
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest()))
    assert sorted(map(tuple, pieces.digest(pieces.encoded(docs, path, packed=True)).collect())) == sorted(want)
    assert all(r["ids"] in ids_of[r["doc_id"]] for r in pieces.encoded(docs, path).collect())
    assert pieces.encoded(none, path).count() == 0
