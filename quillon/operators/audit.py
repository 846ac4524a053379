"""Audit detectors with one finding schema, and the queue they feed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.functions.text import has_negation, is_stale, nonempty_lines, private_symbol, test_symbol
from quillon.operators import cells

FINDING = ("type", "severity", "node_ids", "description", "locus")
#: Methods of a class and definitions of a module beyond which they are reported. Fixed values.
MOST_METHODS, MOST_DEFINITIONS = 25, 30
#: Letters of the runs by which texts that hold a concept are found; concepts have six letters at least.
GRAM = 6


def finding(df: DataFrame, kind: str, severity: str, ids, description, locus=None) -> DataFrame:
    return df.select(F.lit(kind).alias("type"), F.lit(severity).alias("severity"), ids.alias("node_ids"), description.alias("description"), (F.lit(None).cast("string") if locus is None else locus).alias("locus"))


def fingerprint(findings: DataFrame) -> DataFrame:
    """findings with sha1 of type, sorted ids and locus."""
    return findings.withColumn("fingerprint", F.sha1(F.concat_ws("\n", "type", F.array_join(F.sort_array("node_ids"), ","), F.coalesce("locus", F.lit("")))))


def stale(nodes: DataFrame) -> DataFrame:
    return finding(nodes.where(is_stale(F.col("body"))), "stale", "medium", F.array(F.col("id").cast("string")), F.concat(F.col("name"), F.lit(" is marked as superseded")))


def similar_pairs(vectors: DataFrame, low: float, high: float = 2.0, bucket: str | None = None, mark: str | None = None) -> DataFrame:
    """(a, b, cosine) for pairs of one bucket with low <= cosine <= high, a < b, and with mark a marked end; vectors are (id, embedding[, bucket, mark]).

    Exact, through the cells of `cells`: what their bounds rule out is not compared.
    """
    return cells.pairs(vectors, low, high, bucket, mark=mark)


def duplicates(vectors: DataFrame, threshold: float = 0.95, bucket: str | None = "type") -> DataFrame:
    p = similar_pairs(vectors, threshold, bucket=bucket)
    return finding(p, "duplicate", "medium", F.array(F.col("a").cast("string"), F.col("b").cast("string")), F.concat(F.lit("cosine "), F.format_number("cosine", 4)))


def contradictions(vectors: DataFrame, nodes: DataFrame, low: float = 0.5, high: float = 0.85, bucket: str | None = "type") -> DataFrame:
    """Pairs of one type in the band where one body negates; vectors know that before they meet, so no pair is shuffled."""
    flagged = vectors.join(nodes.select("id", has_negation(F.col("body")).alias("negates")), "id")
    p = similar_pairs(flagged, low, high, bucket, "negates")
    return finding(p, "contradiction", "candidate", F.array(F.col("a").cast("string"), F.col("b").cast("string")), F.lit("same topic, one negates"))


def orphan_citations(cited: DataFrame, nodes: DataFrame) -> DataFrame:
    """Cited ids (id, target) that no node has."""
    gone = cited.join(nodes.select(F.col("id").cast("string").alias("target")), "target", "left_anti")
    g = gone.groupBy("id").agg(F.array_join(F.sort_array(F.collect_set("target")), ",").alias("targets"))
    return finding(g, "orphan_reference", "high", F.array(F.col("id").cast("string")), F.concat(F.lit("missing: "), F.col("targets")), F.col("targets"))


def dead_code(symbols: DataFrame, calls: DataFrame) -> DataFrame:
    """Private symbols (id, name[, source_path]) without a caller; tests are called by their runner."""
    path = F.col("source_path") if "source_path" in symbols.columns else F.lit("")
    dead = symbols.where(private_symbol(F.col("name")) & ~test_symbol(F.col("name"), path)).join(calls.select(F.col("dst").alias("id")).distinct(), "id", "left_anti")
    return finding(dead, "dead_code", "candidate", F.array(F.col("id").cast("string")), F.concat(F.col("name"), F.lit(" has no caller")))


def god_objects(members: DataFrame, owners: DataFrame, classes: int = MOST_METHODS, modules: int = MOST_DEFINITIONS) -> DataFrame:
    """Classes with more than `classes` methods and modules, but for tests, with more than `modules` definitions.

    members: (owner, member), one row for each edge; owners: (owner, kind class or module, name, source_path).
    """
    counted = members.groupBy("owner").agg(F.count("*").alias("n"))
    limit = F.when(F.col("kind") == "class", F.lit(classes)).when((F.col("kind") == "module") & ~test_symbol(F.col("name"), F.col("source_path")), F.lit(modules))
    big = counted.join(owners, "owner").where(F.col("n") > limit)
    what = F.when(F.col("kind") == "class", " methods").otherwise(" definitions")
    return finding(big, "god_object", "candidate", F.array(F.col("owner").cast("string")), F.concat(F.col("name"), F.lit(": "), F.col("n").cast("string"), what), F.col("name"))


def undefined_concepts(concepts: DataFrame, definitions: DataFrame) -> DataFrame:
    """Concepts (id, concept) that no other node's name or description holds, whatever the case (definitions: id, name, description).

    Of the nodes that define a concept the least and the greatest id are kept: where they differ every node has one beside itself.

    Containment is an equality with one of the definitions' runs of GRAM letters: a concept is looked up by its rarest run, and
    only texts with that run are compared. A concept shorter than a run is compared by all of it, as runs of each length are kept.
    """
    wanted = concepts.select(F.lower("concept").alias("_c")).where("_c <> ''").distinct()
    runs = lambda c, n: F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - n + 1, F.lit(1))), lambda k: F.substr(c, k, F.lit(n) if isinstance(n, int) else n)))
    short = wanted.where(F.length("_c") < GRAM).select(F.length("_c").alias("n")).distinct().where("n > 0")
    text = definitions.select("id", F.explode(F.array_distinct(F.array_compact(F.array(F.lower("name"), F.lower("description"))))).alias("_t")).groupBy("_t").agg(F.min("id").alias("_low"), F.max("id").alias("_high"))
    keyed = text.select("_t", "_low", "_high", F.explode(runs(F.col("_t"), GRAM)).alias("_g")).where(F.length("_g") == GRAM)
    little = text.join(F.broadcast(short), F.length("_t") >= F.col("n")).select("_t", "_low", "_high", F.explode(runs(F.col("_t"), F.col("n"))).alias("_g"))  # fewer than GRAM lengths
    index = keyed.unionByName(little)
    counts = index.groupBy("_g").agg(F.count("*").alias("_n"))
    picked = wanted.select("_c", F.explode(F.when(F.length("_c") >= GRAM, runs(F.col("_c"), GRAM)).otherwise(F.array("_c"))).alias("_g")).join(counts, "_g", "left")
    rarest = picked.groupBy("_c").agg(F.min_by("_g", F.struct(F.coalesce("_n", F.lit(0)).alias("n"), F.col("_g"))).alias("_g"))
    defined = rarest.join(index, "_g").where(F.contains("_t", F.col("_c"))).groupBy("_c").agg(F.min("_low").alias("_low"), F.max("_high").alias("_high"))
    elsewhere = (F.lower("concept") == F.col("_c")) & ((F.col("_low") != F.col("id")) | (F.col("_high") != F.col("id")))
    gone = concepts.join(defined, elsewhere, "left_anti").select("id", "concept").distinct()
    return finding(gone, "semantic_orphan", "candidate", F.array(F.col("id").cast("string")), F.concat(F.lit("undefined: "), F.col("concept")), F.col("concept"))


def duplicate_code(symbols: DataFrame, vectors: DataFrame, threshold: float = 0.97, lines: int = 5) -> DataFrame:
    """Pairs of functions and methods (id, type, name, source_path, project_key, body) of one project with nearly equal vectors (id, embedding).

    Tests and bodies of fewer than `lines` lines with text are left out; symbols without a project form one of their own.
    """
    fit = symbols.where(F.col("type").isin("code_function", "code_method") & ~test_symbol(F.col("name"), F.col("source_path")) & (nonempty_lines(F.col("body")) >= lines))
    v = fit.select("id", F.coalesce(F.concat(F.lit("p:"), "project_key"), F.lit("")).alias("project")).join(vectors, "id")
    p = similar_pairs(v, threshold, bucket="project")
    named = p.join(fit.select(F.col("id").alias("a"), F.col("name").alias("x")), "a").join(fit.select(F.col("id").alias("b"), F.col("name").alias("y")), "b")
    return finding(named, "duplicate_code", "medium", F.array(F.col("a").cast("string"), F.col("b").cast("string")), F.concat("x", F.lit(" and "), "y", F.lit(" share cosine "), F.format_string("%.3f", "cosine")), F.concat("x", F.lit(" / "), "y"))


def import_cycles(cycles: DataFrame) -> DataFrame:
    """One finding for each cycle (id, cycle)."""
    g = cycles.groupBy("cycle").agg(F.transform(F.sort_array(F.collect_set("id")), lambda x: x.cast("string")).alias("ids"))
    return finding(g, "cyclic_import", "high", F.col("ids"), F.concat(F.size("ids").cast("string"), F.lit(" modules import each other")))


#: Finding type -> the name under which a report counts it. Fixed values.
REPORTED = {"orphan_reference": "orphan_references", "semantic_orphan": "semantic_orphans"}


def tally(findings: DataFrame) -> DataFrame:
    """(type, n) by the names that reports use."""
    name = F.coalesce(F.create_map(*[F.lit(x) for kv in REPORTED.items() for x in kv])[F.col("type")], F.col("type"))
    return findings.groupBy(name.alias("type")).agg(F.count("*").alias("n"))


def proposals(findings: DataFrame, most: int = 50, severities: tuple[str, ...] = ("high", "medium")) -> DataFrame:
    """The first findings that are worth a proposal, a top-k report."""
    return findings.where(F.col("severity").isin(*severities)).orderBy("severity", "fingerprint").limit(most)


def reconcile(queue: DataFrame, fresh: DataFrame, types: list[str], now: int) -> DataFrame:
    """The queue after a run, with each row's change: new, reopened, unchanged, resolved or kept.

    queue and fresh have a fingerprint; a full outer join on it drives the status machine: dismissed stays, resolved reopens,
    open rows of types in scope that are no longer found are resolved, others stay.
    """
    f = fresh.dropDuplicates(["fingerprint"]).select(F.col("fingerprint"), *[F.col(c).alias(f"f_{c}") for c in FINDING], F.lit(True).alias("found"))
    j = queue.join(f, "fingerprint", "full_outer")
    is_new = F.col("status").isNull()
    found = F.col("found").isNotNull()
    gone = ~found & (F.col("status") == "open") & F.col("type").isin(*types)
    change = F.when(is_new, "new").when(found & (F.col("status") == "resolved"), "reopened").when(found, "unchanged").when(gone, "resolved").otherwise("kept")
    status = F.when(is_new | (found & (F.col("status") == "resolved")), "open").when(gone, "resolved").otherwise(F.col("status"))
    return j.select(
        "fingerprint",
        *[F.when(found, F.col(f"f_{c}")).otherwise(F.col(c)).alias(c) for c in FINDING],
        status.alias("status"),
        F.coalesce("first_seen", F.lit(now)).cast("long").alias("first_seen"),
        F.when(found | gone, F.lit(now)).otherwise(F.col("last_seen")).cast("long").alias("last_seen"),
        change.alias("change"),
    )
