"""Quality rules as a learned decision list, in DataFrame functions only.

The statistics of a text are one projection of built-in functions. `learn` is sequential covering:
it grows one conjunction of thresholds after the other on labelled statistics, prunes each on rows held
out, and stops when the next rule is not precise enough. `decision` turns the list into one ordered
`when` chain, so applying it to a corpus is a projection without shuffle.

Defined results: a null or empty text has no words, all its counts are 0 and it fails the base rule;
repeated rows and rows without an id are judged each; other columns of the input never clash, because only the named ones are
read. Without labelled rows of both kinds the list is empty and the base rule alone decides.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.base import let, words_of

#: Characters that count as symbols. Fixed by the contract.
SYMBOLS = r"[#*$%&|<>]"
#: At most so many labelled documents train the list: those with the smallest hash of their doc_id.
MAX_LABELLED = 20_000
FEATURES = ("n_words", "word_length", "symbol_share", "capital_share", "mark_share", "dup_line_share", "repeat_share", "distinct_share")


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def holds(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return x[self.feature] >= self.threshold if self.above else x[self.feature] < self.threshold

    def column(self) -> Column:
        return F.col(self.feature) >= F.lit(self.threshold) if self.above else F.col(self.feature) < F.lit(self.threshold)

    def __str__(self) -> str:
        return f"{self.feature} {'>=' if self.above else '<'} {self.threshold:.6g}"


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts and shares of every text: (id_col, the counts of the contract, FEATURES)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(F.col(id_col), text.alias("_t"), words_of(text).alias("_w"))
    lines = F.filter(F.split("_t", "\n", -1), lambda x: x.rlike(r"[^ \t-\r]"))
    triples = F.when(
        F.size("_w") >= 3,
        F.transform(F.slice("_w", 1, F.size("_w") - 2), lambda w, i: F.concat_ws(" ", w, F.get("_w", i + 1), F.get("_w", i + 2))),
    ).otherwise(F.array().cast("array<string>"))
    parts = base.select(
        id_col,
        F.size("_w").cast("long").alias("n_words"),
        F.char_length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        (F.char_length("_t") - F.char_length(F.regexp_replace("_t", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.char_length("_t") - F.char_length(F.regexp_replace("_t", "[A-Z]+", ""))).cast("long").alias("_capitals"),
        (F.char_length("_t") - F.char_length(F.regexp_replace("_t", "[!?]+", ""))).cast("long").alias("_marks"),
        let(lines, lambda x: F.struct(F.size(x).alias("n"), F.size(F.array_distinct(x)).alias("d"))).alias("_lines"),
        F.size(F.array_distinct("_w")).alias("_distinct"),
        triples.alias("_g"),
    )
    # Triples that occur twice or more: sorted with their places, equal neighbours are the repeats.
    repeated = let(
        F.sort_array(F.transform("_g", lambda g, i: F.struct(g.alias("g"), i.alias("i")))),
        lambda s: F.filter(s, lambda x, k: (F.get(s, k + 1)["g"].eqNullSafe(x["g"])) | ((k > 0) & F.get(s, k - 1)["g"].eqNullSafe(x["g"]))),
    )
    covered = F.size(F.array_distinct(F.flatten(F.transform(repeated, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2)))))
    counted = parts.withColumn("n_repeat_words", F.when(F.size(F.array_distinct("_g")) == F.size("_g"), F.lit(0)).otherwise(covered).cast("long"))
    one = lambda c: F.greatest(F.col(c), F.lit(1)).cast("double")
    made = F.struct(
        F.col(id_col),
        F.col("n_words"),
        F.col("word_chars"),
        F.col("n_symbols"),
        (F.col("_lines.n") - F.col("_lines.d")).cast("long").alias("n_dup_lines"),
        F.col("n_repeat_words"),
        (F.col("word_chars") / one("n_words")).alias("word_length"),
        (F.col("n_symbols") / one("word_chars")).alias("symbol_share"),
        (F.col("_capitals") / one("word_chars")).alias("capital_share"),
        (F.col("_marks") / one("n_words")).alias("mark_share"),
        ((F.col("_lines.n") - F.col("_lines.d")) / one("_lines.n")).alias("dup_line_share"),
        (F.col("n_repeat_words") / one("n_words")).alias("repeat_share"),
        (F.col("_distinct") / one("n_words")).alias("distinct_share"),
    )
    # An explode bars the optimizer from writing these expressions into later filters once more for each use.
    return counted.select(F.explode(F.array(made)).alias("_made")).select("_made.*")


def labelled(docs: DataFrame, labels: DataFrame, limit: int = MAX_LABELLED) -> DataFrame:
    """Statistics with the quality label of at most `limit` labelled documents."""
    known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").cast("int").alias("_quality"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # at most `limit` pairs of numbers
    return statistics(texts.drop("_quality")).join(F.broadcast(chosen), "doc_id")


def grow(x: dict[str, np.ndarray], bad: np.ndarray, most: int, bins: int) -> list[Condition]:
    """One conjunction, condition by condition, by information gain against what it covers so far."""
    rule: list[Condition] = []
    inside = np.ones(len(bad), bool)
    while len(rule) < most and not bad[inside].all():
        p0, n0 = int(bad[inside].sum()), int((~bad[inside]).sum())
        best, gain = None, 1e-9
        for name in FEATURES:
            v, b = x[name][inside], bad[inside]
            cuts = np.unique(np.quantile(v, np.linspace(0, 1, bins + 1)))
            order = np.argsort(v, kind="stable")
            below = np.concatenate([[0], np.cumsum(b[order])])
            at = np.searchsorted(v[order], cuts, side="left")
            for above in (True, False):
                p = (below[-1] - below[at]) if above else below[at]
                n = ((len(v) - at) if above else at) - p
                with np.errstate(divide="ignore", invalid="ignore"):
                    g = np.where(p > 0, p * (np.log2(p / (p + n)) - np.log2(p0 / (p0 + n0))), -1.0)
                k = int(np.argmax(g))
                if g[k] > gain:
                    best, gain = Condition(name, above, float(cuts[k])), float(g[k])
        if best is None:
            break
        rule.append(best)
        inside &= best.holds(x)
    return rule


def prune(rule: list[Condition], x: dict[str, np.ndarray], bad: np.ndarray) -> list[Condition]:
    """The shortest beginning of the rule that is worth most on rows held out."""
    best, worth = rule, -2.0
    inside = np.ones(len(bad), bool)
    for k, c in enumerate(rule):
        inside = inside & c.holds(x)
        p, n = int((inside & bad).sum()), int((inside & ~bad).sum())
        if p + n and (w := (p - n) / (p + n)) > worth:
            best, worth = rule[: k + 1], w
    return best


def learn(rows: list, max_rules: int = 12, max_conditions: int = 4, precision: float = 0.9, least: int = 3, bins: int = 64) -> list[list[Condition]]:
    """Sequential covering over labelled rows (Row with FEATURES and _quality; 0 is bad)."""
    rows = sorted(rows, key=lambda r: r["doc_id"])
    bad = np.array([r["_quality"] == 0 for r in rows], bool)
    if not len(rows) or bad.all() or not bad.any():
        return []
    x = {f: np.array([float(r[f]) for r in rows]) for f in FEATURES}
    held = np.arange(len(rows)) % 3 == 2  # every third row prunes
    left = np.ones(len(rows), bool)
    rules: list[list[Condition]] = []
    while len(rules) < max_rules and (bad & left & ~held).sum() >= least:
        part = lambda keep: ({f: v[keep] for f, v in x.items()}, bad[keep])
        rule = grow(*part(left & ~held), max_conditions, bins)
        if not rule:
            break
        rule = prune(rule, *part(left & held))
        inside = left & np.logical_and.reduce([c.holds(x) for c in rule])
        p, n = int((inside & bad).sum()), int((inside & ~bad).sum())
        held_p, held_n = int((inside & held & bad).sum()), int((inside & held & ~bad).sum())
        if p < least or p / (p + n) < precision or (held_p + held_n and held_p / (held_p + held_n) < precision):
            break
        rules.append(rule)
        left &= ~inside
    return rules


def decision(rules: list[list[Condition]]) -> Column:
    """Number of the first rule that fires, from 1; 0 for none."""
    out = None
    for k, rule in enumerate(rules, 1):
        fires = rule[0].column()
        for c in rule[1:]:
            fires = fires & c.column()
        out = F.when(fires, F.lit(k)) if out is None else out.when(fires, F.lit(k))
    return (out.otherwise(F.lit(0)) if out is not None else F.lit(0)).cast("int")


def judge(docs: DataFrame, labels: DataFrame, limit: int = MAX_LABELLED) -> DataFrame:
    """Every document's counts, base_failed, the rule that rejects it (0: none) and kept."""
    rules = learn(labelled(docs, labels, limit).collect())  # at most `limit` rows of numbers
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return (
        statistics(docs)
        .withColumn("base_failed", failed)
        .withColumn("rule", decision(rules))
        .select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "rule", (~F.col("base_failed") & (F.col("rule") == 0)).alias("kept"))
    )


def kept(docs: DataFrame, labels: DataFrame, limit: int = MAX_LABELLED) -> DataFrame:
    """The rows of docs that judge keeps, with all their columns, in one projection without a join."""
    rules = learn(labelled(docs, labels, limit).collect())  # at most `limit` rows of numbers
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col("text").alias("_text"))
    return statistics(rows, "_row", "_text").where(~failed & (decision(rules) == 0)).select("_row.*")
