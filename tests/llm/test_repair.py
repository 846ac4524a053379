"""Conversation repair against all edit strings, and by any size of chunks."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
import zlib

from quillon.llm import turn_repair

SPACE = " \t\n\x0b\x0c\r"


def faults_of(rows):
    seen, out = set(), []
    for role, text in rows:
        bare = text.rstrip(SPACE)
        out.append("B" if not bare else "D" if (role, text) in seen else "-" if bare[-1] in ".!?" else "T")
        seen.add((role, text))
    return out


def every_way(rows):
    """(cost, edits, repaired rows) of the least of all edit strings with at most two inserts at a place."""
    faults, best = faults_of(rows), None
    for inserts in itertools.product(range(3), repeat=len(rows) + 1):
        for edits in itertools.product("DKR", repeat=len(rows)):
            text, cost, made = "", 0, []
            for k in range(len(rows) + 1):
                text += "I" * inserts[k]
                cost += 3 * inserts[k]
                made += [(None, "")] * inserts[k]
                if k < len(rows):
                    text += edits[k]
                    if edits[k] == "D":
                        cost += 4
                        continue
                    if faults[k] in "BD":
                        break
                    cost += (3 if edits[k] == "R" else 0) + (3 if faults[k] == "T" else 0)
                    made.append((rows[k][0] if edits[k] == "K" else None, rows[k][1]))
            else:
                if best and (cost, text) >= best[:2]:
                    continue
                for first in ("", "s"):
                    if not made and not first:
                        roles = []
                    elif first and (not made or (made[0][0] or "")[:1] != "s"):
                        continue
                    else:
                        body = len(made) - len(first)
                        if body == 0 or body % 2:
                            continue
                        roles = ([made[0][0]] if first else []) + ["user", "assistant"] * (body // 2)
                    if all(r is None or r[:1] == want[:1] for (r, _), want in zip(made, roles, strict=True)):
                        best = (cost, text, [(r or want, t) for (r, t), want in zip(made, roles, strict=True)])
    return best


def conversations(rng, n):
    texts = ["Yes.", "No!", "Why", "a b", "", " \n", "Ok? ", "Ok? ", "é."]
    return [[(rng.choice(["user", "assistant", "system", "user", "assistant", "tool", ""]), rng.choice(texts)) for _ in range(rng.randint(0, 4))] for _ in range(n)]


def frame(spark, held):
    rows = [(k, t, role, text, "x") for k, c in enumerate(held) for t, (role, text) in enumerate(c)]
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, rank string").repartition(3)


def test_least_of_all_edits_in_chunks_of_any_size(spark):
    held = conversations(random.Random(5), 60)
    want = {k: every_way(c) for k, c in enumerate(held)}
    given = frame(spark, held)
    ids = spark.range(len(held)).withColumnRenamed("id", "conv_id")
    for size in (1, 2, 1024):
        made = turn_repair.Repair(given, size)
        for r in made.report(ids).collect():
            cost, audit, rows = want[r["conv_id"]]
            assert (r["cost"], r["audit"]) == (cost, audit), held[r["conv_id"]]
            assert r["repaired_sha256"] == hashlib.sha256("\n".join(f"{a}:{b}" for a, b in rows).encode()).hexdigest()
            faults = faults_of(held[r["conv_id"]])
            assert [r["blank"], r["duplicate"], r["truncated"]] == [faults.count(x) for x in "BDT"]
        turns = {}
        for r in made.turns().collect():
            turns.setdefault(r["conv_id"], []).append((r["position"], r["role"], r["text"]))
        assert {k: [(b, c) for _, b, c in sorted(v)] for k, v in turns.items()} == {k: v[2] for k, v in want.items() if v[2]}


def test_a_long_conversation_in_chunks(spark):
    rng = random.Random(6)
    held = [[(rng.choice(["user", "assistant", "system"]), rng.choice(["Yes.", "No", f"{k}.", f"{k}", ""])) for k in range(300)]]
    ids = spark.range(1).withColumnRenamed("id", "conv_id")
    got = [turn_repair.Repair(frame(spark, held), size).report(ids).collect() for size in (7, 1024)]
    assert got[0] == got[1] and re.fullmatch("[DIKR]+", got[0][0]["audit"])


def test_damage_nulls_and_ties(spark, sf):
    rows = [(None, None, None, None), (None, 3, "user", "Hi."), (7, None, "user", None), (7, None, None, "b"), (7, 1, "user", "x." * 40_000), (7, 9, "assistant", "y"), (7, 9, "assistant", "y"), (8, 2, "user", "q?")]
    given = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    want = []
    for c, t, role, text in rows:
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = role or " ", text or " "
        if kind:
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            want += [(c, t, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    key = lambda r: tuple((x is not None, x) for x in r)
    damaged = turn_repair.damaged(given)
    assert sorted(map(tuple, damaged.collect()), key=key) == sorted(want, key=key)
    got = {r["conv_id"]: r for r in turn_repair.Repair(given).report(given).collect()}
    assert set(got) == {None, 7, 8}
    assert got[7]["gaps"] == 7 and got[7]["duplicate"] == 1 and got[7]["blank"] == 1 and got[None]["gaps"] == 0
    assert turn_repair.Repair(given.limit(0)).report(given.limit(0)).count() == 0
    assert turn_repair.Repair(given.limit(0)).report(given).where("audit = '' and cost = 0").count() == 3
