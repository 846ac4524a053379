"""The Merkle manifest against one written by recursion."""

from __future__ import annotations

import hashlib
import zlib

from quillon.llm import merkle


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, text):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (*row[:4], text)))


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h(*out[-1][k : k + 8]) for k in range(0, len(out[-1]), 8)])
    return out


def proof(tree, at):
    """(siblings before, after) from the leaf up."""
    for level in tree[:-1]:
        run = at // 8 * 8
        yield "".join(level[run:at]), "".join(level[at + 1 : run + 8])
        at //= 8


def by_hand(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append(r)
    trees, held = {}, {}
    for lang, own in groups.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[4])))
        held[lang], trees[lang] = own, levels([leaf(r, r[4]) for r in own])
    names = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    crown = levels([trees[n][-1][0] for n in names])
    root = crown[-1][0]
    for k, n in enumerate(names):
        for at, r in enumerate(held[n]):
            steps = [*proof(trees[n], at), *proof(crown, k)]
            tampered = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0
            text = "".join(c.lower() if "A" <= c <= "Z" else c for c in r[4]) if tampered and r[4] is not None else r[4]
            now = leaf(r, text)
            for before, after in steps:
                now = h(before, now, after)
            yield r[0], leaf(r, r[4]), trees[n][-1][0], root, h(*(a + b for a, b in steps)), now, now == root


def check(spark, rows):
    docs = spark.createDataFrame([(*r, "x", "y") for r in rows], "doc_id long, source string, lang string, n_chars long, text string, key string, rank string").repartition(4)
    got = merkle.proved(merkle.manifest(docs, merkle.one_in_three(docs["doc_id"]))).collect()
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted(map(tuple, got), key=key) == sorted(by_hand(rows), key=key)


def test_many_languages_nulls_ties_and_lone_leaves(spark):
    rows = [(k, "s", "en", 5, f"Text {k}") for k in range(73)] + [(k, None, "ünï", None, None if k % 3 else "É A") for k in range(9)]
    rows += [(k, "", f"l{k}", 0, "") for k in range(70)] + [(None, None, None, None, None), (5, "s", "en", 5, "Text 5"), (5, "s", "en", 6, "Other"), (6, "a", None, 1, "Long " * 60_000)]
    check(spark, rows)


def test_one_row_and_none(spark, none):
    check(spark, [(1, "s", "en", 3, "Abc")])
    check(spark, [(3, "s", "en", 3, "Abc"), (1, "s", "en", 3, "abc")])
    from pyspark.sql import functions as F

    empty = none.select("doc_id", "text", F.lit("x").alias("lang"), F.lit("x").alias("source"), F.lit(1).alias("n_chars"))
    assert merkle.proved(merkle.manifest(empty)).count() == 0
