"""Chat formatting, licence scans, URL rules and quality rules."""

from __future__ import annotations

import hashlib
import json
import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillon.llm import chat_format as chat
from quillon.llm import license_scan, quality_rules, url_filter


def test_escape_round_trip_and_no_control_string_left(spark):
    parts = [*chat.CONTROL, "<", "[", "\\", "|", "a", "\n", "<|", "im_end|>", "/s>"]
    rng = random.Random(3)
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 12))) for _ in range(500)]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", chat.escape(F.col("t")).alias("e"))
    for r in df.select("t", "e", chat.unescape(F.col("e")).alias("u")).collect():
        assert r["u"] == r["t"] and not any(c in r["e"] for c in chat.CONTROL)


def test_layouts_give_the_same_turns(spark):
    want = [("user", "hi"), ("assistant", "yo")]
    rows = {
        "messages": {"messages": [{"role": "user", "content": "hi"}, {"role": "assistant", "content": "yo"}]},
        "from_value": {"conversations": [{"from": "human", "value": "hi"}, {"from": "gpt", "value": "yo"}]},
        "prompt": {"prompt": "hi", "completion": "yo"},
        "response": {"prompt": "hi", "response": "yo"},
        "instruction": {"instruction": "hi", "input": "", "output": "yo"},
        "question": {"question": "hi", "answer": "yo"},
        "unknown": {"foo": 1},
        "null": {"prompt": None, "completion": "yo"},
    }
    df = spark.createDataFrame([(k, json.dumps(v)) for k, v in rows.items()] + [("bad", "no json"), ("none", None)], "conv_id string, j string")
    got = {r["conv_id"]: r["turns"] for r in chat.canonical_json(df, "conv_id", "j").collect()}
    for k in rows:
        if k == "unknown":
            assert got[k] is None
        elif k == "null":
            assert [tuple(t) for t in got[k]] == [("user", ""), ("assistant", "yo")]
        else:
            assert [tuple(t) for t in got[k]] == want, k
    assert got["bad"] is None and got["none"] is None
    typed = spark.createDataFrame([(1, "hi", "yo", "z")], "conv_id long, prompt string, completion string, extra string")
    assert [tuple(t) for t in chat.canonical(typed).first()["turns"]] == want
    with pytest.raises(ValueError):
        chat.canonical(spark.createDataFrame([(1, 2)], "conv_id long, foo long"))


def test_digest_reads_back_the_turns(spark):
    rows = [(1, 0, "user", "a</s>"), (1, 1, "assistant", "b\\<s>\nc"), (1, 2, None, None), (2, 0, "assistant", ""), (1, 1, "assistant", "b\\<s>\nc")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, segments string")
    got = {r["conv_id"]: r for r in chat.digest(chat.formatted(chat.canonical(df))).collect()}
    turns = [("user", "a</s>"), ("assistant", "b\\<s>\nc"), ("assistant", "b\\<s>\nc"), ("", "")]
    assert got[1]["n_turns"] == 4 and got[1]["turns_sha256"] == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
    assert got[1]["loss_chars"] == 14 and got[1]["loss_sha256"] == hashlib.sha256(("b\\<s>\nc" * 2).encode()).hexdigest()
    assert got[2]["loss_chars"] == 0
    assert chat.digest(chat.formatted(chat.canonical(df.limit(0)))).count() == 0


def brute_url(url, rules):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host, path = ("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in m[1]), m[2]) if m else ("", "")
    fit = [(len(h) + len(p), len(h), h + p, v) for h, p, v in rules if host and (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(max(fit)[2:] if fit else (None, "allow")))


def test_url_rules_equal_brute_force(spark):


    rng = random.Random(5)
    labels = ["com", "net", "a", "b", "x-y"]
    host = lambda: ".".join(rng.choices(labels, k=rng.randint(1, 4)))
    path = lambda: "/" + "/".join(rng.choices(["e", "en", "7", "71", ""], k=rng.randint(0, 3)))
    rules = list({(h, p): (h, p, rng.choice(["block", "allow"])) for h, p in ((host(), path()) for _ in range(60))}.values())
    urls = [None, "", "no scheme", "http://", "HTTP://A.COM/en?x#y", "x://a.com", "http://a.com?q=/en/", "http://a.com#f", "ftp://b.net://c/e"] + [f"http://{host()}{path()}{rng.choice(['', '?q', '#f'])}" for _ in range(400)]
    urls += urls[5:8]
    pages = spark.createDataFrame([(k, u, "z", "z") for k, u in enumerate(urls)], "page_id long, url string, host string, rule string")
    got = {r["page_id"]: tuple(r)[1:] for r in url_filter.judge(pages, url_filter.rule_table(spark, rules), part=3).collect()}
    assert got == {k: brute_url(u, rules) for k, u in enumerate(urls)}
    assert {r["verdict"] for r in url_filter.judge(pages, url_filter.rule_table(spark, ())).collect()} == {"allow"}
    assert url_filter.judge(pages.limit(0), url_filter.rule_table(spark)).count() == 0


def dice(a, b):
    return 2 * len(a & b) / (len(a) + len(b)) if a and b else 0.0


def test_licences_equal_brute_force(spark, docs, none, plain):
    gram = lambda t: set(license_scan.bigrams_of(t))
    want = []
    for doc_id, text in plain:
        lines = (text or "").split("\n")
        for k, unit in [*enumerate(lines, 1), *([(0, text)] if len(lines) > 1 else [])]:
            score = {n: dice(gram(unit), gram(t)) for n, t in license_scan.TEMPLATES.items()}
            best = min((-s, n) for n, s in score.items())
            if -best[0] >= license_scan.THRESHOLD:
                want.append((doc_id, k, best[1], round(-best[0], 9)))
    got = sorted((r["doc_id"], r["line"], r["license"], round(r["dice"], 9)) for r in license_scan.scan(docs).collect())
    assert got == sorted(want) and got
    assert license_scan.scan(none).count() == 0 and license_scan.scan(docs, {}).count() == 0
    full = spark.createDataFrame([(1, license_scan.TEMPLATES["MIT/text"].replace(". ", ".\n"))], "doc_id long, text string")
    assert {(r["line"], r["license"]) for r in license_scan.scan(full).collect()} == {(0, "MIT/text")}


def brute_quality(text):
    t = text or ""
    w = [x for x in re.split(r"[ \t-\r]+", t) if x]
    lines = [x for x in t.split("\n") if re.search(r"[^ \t-\r]", x)]
    grams = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
    twice = {g for g in grams if grams.count(g) > 1} if len(grams) < 3000 else {g for g, n in __import__("collections").Counter(grams).items() if n > 1}
    hit = {k + j for k, g in enumerate(grams) if g in twice for j in range(3)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(hit), len(w) < 50 or 100 * len(hit) > 50 * len(w)


def test_quality_counts_equal_brute_force(docs, none, plain, labels, corpus):
    got = quality_rules.judge(docs, labels.limit(0))
    rows = sorted((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) for r in got.collect())
    assert rows == sorted((i, *brute_quality(t)) for i, t in plain)
    assert all(r["kept"] == (not r["base_failed"]) for r in got.collect())
    assert quality_rules.judge(none, labels).count() == 0
    texts = {r["doc_id"]: r["text"] for r in corpus.collect()}
    for r in quality_rules.judge(corpus, labels).collect():
        assert tuple(r)[1:7] == brute_quality(texts[r["doc_id"]])


def test_learned_rules_are_precise_on_held_out_rows(corpus, labels, spark):
    larger = "/root/testdata/sf0.1"
    rows = quality_rules.labelled(spark.read.parquet(f"{larger}/documents.parquet"), spark.read.parquet(f"{larger}/labels.parquet")).collect()
    rows.sort(key=lambda r: r["doc_id"])
    rules = quality_rules.learn(rows[::2])
    assert rules
    judged = [(any(all((r[c.feature] >= c.threshold) == c.above for c in rule) for rule in rules), r["_quality"] == 0) for r in rows[1::2] if r["n_words"] >= 50]
    hit = sum(a and b for a, b in judged)
    assert hit / max(1, sum(a for a, _ in judged)) >= 0.8 and hit / max(1, sum(b for _, b in judged)) >= 0.6
    assert quality_rules.learn([]) == []


def test_kept_rows_carry_all_columns(docs, labels):
    out = quality_rules.kept(docs, labels.limit(0))
    assert out.columns == docs.columns and {r["doc_id"] for r in out.collect()} == {8, 9} & {r["doc_id"] for r in quality_rules.judge(docs, labels.limit(0)).where("kept").collect()}


@settings(max_examples=30, deadline=None)
@given(st.lists(st.text(max_size=6), max_size=4))
def test_fingerprint_ignores_order(paths):
    assert chat.fingerprint(paths) == chat.fingerprint(paths[::-1])


def test_wrapped_and_embedded_notices_are_found(spark):
    import textwrap

    wrap = lambda name, mark: "\n".join(mark + x for x in textwrap.wrap(license_scan.TEMPLATES[name], 60))
    filler = "\n".join(f"code line {k} holds item{k} and other{k} words{k}" for k in range(60))
    names = ("MIT/text", "ISC/text", "Apache-2.0/header", "GPL-3.0/header")
    rows = [(k, f"{filler}\n{wrap(n, ' * ')}\n{filler}") for k, n in enumerate(names)]
    rows += [(4, "some words here before. Released under the MIT License. and many more words in the same line after it"), (5, filler), (6, f"{filler}\n{wrap('MIT/text', '# ')}\n{filler}\n{wrap('MIT/text', '// ')}")]
    got = {tuple(r)[:3] for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect() if r["dice"] == 1.0}
    assert {(k, 61, n) for k, n in enumerate(names)} <= got and (4, 1, "MIT/notice") in got
    at = 61 + 60 + len(wrap("MIT/text", "# ").split("\n"))
    assert {(6, 61, "MIT/text"), (6, at, "MIT/text")} <= got and not any(i == 5 for i, _, _ in got)


def licenses_by_hand(text, templates, threshold):
    """All units and all windows between bigrams of a template, in plain loops."""
    norm = lambda x: re.sub("[^a-z0-9]+", " ", x.lower()).split()
    grams = lambda w: [f"{a} {b}" for a, b in zip(w, w[1:], strict=False)]
    held = {n: set(license_scan.bigrams_of(t)) for n, t in sorted(templates.items())}
    lines = text.split("\n")
    units = []
    for line, t in [*enumerate(lines, 1), *([(0, text)] if len(lines) > 1 else [])]:
        own = set(grams(norm(t)))
        scored = [(2.0 * len(own & b) / (len(own) + len(b)), n, len(own & b)) for n, b in held.items() if own]
        best = max((s[0] for s in scored), default=0)
        if best >= threshold:
            units.append((line, *next(s for s in scored if s[0] == best)))
    of = [k for k, t in enumerate(lines, 1) for _ in norm(t)]
    pairs, found = grams(norm(text)), []
    for name, b in held.items():
        hits = [k for k, g in enumerate(pairs) if g in b]
        for s in hits:
            best = None
            for e in hits:
                if s <= e and e - s < len(b) * (2 - threshold) / threshold:
                    own = set(pairs[s : e + 1])
                    dice = 2.0 * len(own & b) / (len(own) + len(b))
                    if dice >= threshold and (best is None or dice > best[1]):
                        best = (len(own & b), dice, -s, e, name)
            if best:
                found.append(best)
    kept = []
    for x in sorted(found, reverse=True):
        if not any(-y[2] <= x[3] + 1 and -x[2] <= y[3] + 1 for y in kept):
            kept.append(x)
    out = [(line, name, dice) for line, dice, name, _ in units]
    for shared, dice, s, e, name in kept:
        if not any(u[3] >= shared and (u[0] == 0 or of[-s] <= u[0] <= of[e + 1]) for u in units):
            out.append((of[-s], name, dice))
    return out


def test_license_passages_against_all_windows(spark):
    rng = random.Random(31)
    templates = {"A/x": "one two three four five six seven", "B/x": "two three four five blue red", "C/x": "alpha beta gamma delta"}
    texts = []
    for _ in range(150):
        parts = []
        for _ in range(rng.randint(1, 5)):
            words = rng.choice([*templates.values(), "a b c d e f g", "one two red"]).split()
            for _ in range(rng.randint(0, 2)):
                words.insert(rng.randint(0, len(words)), rng.choice(["a", "b", "two", "blue"]))
            parts.append(rng.choice([" ", "\n", " . "]).join(words) if rng.random() < 0.5 else "".join(w + rng.choice([" ", " ", "\n"]) for w in words))
        texts.append(rng.choice([" ", "\n", "\n\n"]).join(parts))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for threshold in (0.6, 0.8):
        got = sorted((r["doc_id"], r["line"], r["license"], round(r["dice"], 12)) for r in license_scan.scan(df, templates, threshold).collect())
        want = sorted((k, line, name, round(dice, 12)) for k, t in enumerate(texts) for line, name, dice in licenses_by_hand(t, templates, threshold))
        assert got == want
        assert any(x[1] > 0 for x in got)
