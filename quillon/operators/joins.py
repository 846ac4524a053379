"""Joins of the knowledge graph: overlap, ownership, containment, resolution, freshness."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.window import Window

from quillon.functions.text import ancestors

#: Lines of one bucket of an interval join: a range is copied to each bucket that it touches.
BUCKET = 64
#: Ranges of a commit in a file that stand in one row.
HUNKS = 64
#: Commits of one row, of one list while it is gathered on average at most, of one task, and of a file that meet a copy of its symbols; files that are sent to every task.
LIST, SALT, TASK_COMMITS, DEAL, FILES = 4096, 1 << 20, 1 << 18, 1 << 13, 100_000
#: Names of one automaton, and bytes of text that a group of a scan in blocks reads.
NAMES, TEXT_BYTES = 50_000, 32 << 20


def overlaps(left: DataFrame, right: DataFrame, on: str, bucket: int = BUCKET) -> DataFrame:
    """Rows of left (on, a, b, ...) with those of right (on, c, d, ...) whose ranges [a, b] and [c, d] meet.

    An equi join on (on, bucket); a pair is kept only in the bucket where its overlap starts, so it comes once.
    """
    cut = lambda df, x, y: df.withColumn("_bucket", F.explode(F.sequence(F.floor(F.col(x) / bucket), F.floor(F.col(y) / bucket))))
    met = cut(left, "a", "b").join(cut(right, "c", "d"), [on, "_bucket"])
    return met.where("a <= d AND c <= b").where(F.floor(F.greatest("a", "c") / bucket) == F.col("_bucket")).drop("_bucket")


def references(spans: DataFrame, hunks: DataFrame, low: float = 0.3, digits: int | None = None) -> DataFrame:
    """(commit_id, file, symbol, a, b, confidence): share of a symbol's lines (file, symbol, a, b) that a commit's hunks (commit_id, file, a, b) touch, at least `low` and at most 1, to `digits` if given.

    Touched ranges are not merged: lines that two hunks touch count twice. The pairs are the result and stay where they are met. Commits whose
    one range in a file is the same stand together, LIST in a row at most: a symbol meets the range once, and only then the commits come apart. Of
    commits with more, up to HUNKS ranges of a commit in a file stand in one row, and only commits with more than that have their pairs
    shuffled and summed. A file's commits are dealt to tasks by DEAL, each with a copy of the file's symbols, so that no task holds a file that many commits touch.
    """
    h = hunks.where("commit_id IS NOT NULL AND file IS NOT NULL AND a IS NOT NULL AND b IS NOT NULL").select("commit_id", "file", F.col("a").alias("c"), F.col("b").alias("d"))
    of = h.groupBy("file").agg(F.count("*").alias("n"))
    few_files = of.limit(FILES + 1).toArrow()
    known = few_files.num_rows <= FILES  # then symbols of other files are left out where they are read
    total = pc.sum(few_files["n"]).as_py() or 0 if known else h.count()
    files = (F.broadcast(h.sparkSession.createDataFrame(few_files)) if known else of).select("file", F.ceil(F.col("n") / DEAL).cast("int").alias("_deals"))
    s = spans.join(files.select("file"), "file", "left_semi").groupBy("file", "symbol", "a", "b").agg(F.count("*").alias("_m"))
    size = F.greatest(F.lit(1), F.col("b") - F.col("a") + 1)
    least, greatest = (lambda x, y: F.when(x < y, x).otherwise(y)), (lambda x, y: F.when(x < y, y).otherwise(x))

    def bound(share: Column) -> Column:
        made = F.greatest(F.lit(low), F.least(F.lit(1.0), share))
        return (made if digits is None else F.round(made, digits)).alias("confidence")

    # Both sides are in tasks by commits, not by bytes: rows are few before commits come apart.
    tasks = max(2 * h.sparkSession.sparkContext.defaultParallelism, -(-total // TASK_COMMITS))
    keys = ["file", "_bucket", "_deal"]
    cut = lambda x, y: F.sequence(F.floor(x / BUCKET), F.floor(y / BUCKET))
    left = s.join(files, "file").withColumn("_deal", F.explode(F.sequence(F.lit(0), F.col("_deals") - 1))).drop("_deals")
    left = left.withColumn("_bucket", F.explode(cut(F.col("a"), F.col("b")))).repartition(tasks, *keys)
    put = lambda df, *by: df.join(files, "file").withColumn("_deal", F.pmod(F.xxhash64(*by), F.col("_deals")).cast("int")).drop("_deals")
    counted = h.withColumn("_n", F.count("*").over(Window.partitionBy("commit_id", "file")))

    # One range: its commits in lists, which salts bound by their number.
    salt = F.pmod(F.xxhash64("commit_id"), F.lit(max(1, -(-total // SALT))))
    same = counted.where("_n = 1").groupBy("file", "c", "d", salt.alias("_salt")).agg(F.collect_list("commit_id").alias("_all"))
    lists = F.transform(F.sequence(F.lit(0), F.floor((F.size("_all") - 1) / LIST).cast("int")), lambda k: F.slice("_all", k * LIST + 1, LIST))
    right = put(same.select("file", "c", "d", "_salt", F.posexplode(lists).alias("_k", "_all")), "c", "d", "_salt", "_k").drop("_salt", "_k")
    right = right.withColumn("_bucket", F.explode(cut(F.col("c"), F.col("d")))).repartition(tasks, *keys)
    from_, to = greatest(F.col("a"), F.col("c")), least(F.col("b"), F.col("d"))  # a pair is kept in the bucket where its overlap starts
    met = left.join(right, keys).where("a <= d AND c <= b").where(F.floor(from_ / BUCKET) == F.col("_bucket"))
    met = met.select("_all", "file", "symbol", "a", "b", bound((to - from_ + 1) * F.col("_m") / size))
    one = met.select(F.explode("_all").alias("commit_id"), "file", "symbol", "a", "b", "confidence")

    # Few ranges: copied to every bucket that one of them touches; a pair is kept in the first bucket where a range meets the symbol.
    listed = counted.where(F.col("_n").between(2, HUNKS)).groupBy("commit_id", "file").agg(F.collect_list(F.struct("c", "d")).alias("r"))
    right = put(listed, "commit_id").withColumn("_bucket", F.explode(F.array_distinct(F.flatten(F.transform("r", lambda x: cut(x["c"], x["d"])))))).repartition(tasks, *keys)
    hit = F.filter("r", lambda x: (x["c"] <= F.col("b")) & (x["d"] >= F.col("a")))
    first = F.array_min(F.transform("_hit", lambda x: F.floor(greatest(F.col("a"), x["c"]) / BUCKET)))
    lines = F.aggregate("_hit", F.lit(0).cast("long"), lambda n, x: n + (least(F.col("b"), x["d"]) - greatest(F.col("a"), x["c"]) + 1).cast("long"))
    met = left.join(right, keys).withColumn("_hit", hit).where((F.size("_hit") > 0) & (first == F.col("_bucket")))
    few = met.select("commit_id", "file", "symbol", "a", "b", bound(lines * F.col("_m") / size))

    rest = counted.where(F.col("_n") > F.greatest(F.lit(1), F.lit(HUNKS))).select("commit_id", "file", "c", "d")
    share = F.sum((F.least("b", "d") - F.greatest("a", "c") + 1) * F.col("_m")) / size
    many = overlaps(s, rest, "file").groupBy("commit_id", "file", "symbol", "a", "b").agg(bound(share))
    return one.unionByName(few).unionByName(many)


def owned(nodes: DataFrame, sources: DataFrame) -> DataFrame:
    """(id, path): every source that a node stands under; ownership by prefix is an equality with one of the node's ancestors."""
    return nodes.select("id", F.explode(ancestors(F.col("source_path"))).alias("path")).join(sources.select("path"), "path")


def unowned(nodes: DataFrame, sources: DataFrame) -> DataFrame:
    return nodes.join(owned(nodes, sources).select("id").distinct(), "id", "left_anti")


def named_in(texts: DataFrame, names: DataFrame) -> DataFrame:
    """(text_id, name_id): names (name_id, name) that stand in texts (text_id, text) between word edges, each pair once.

    Names may have blanks, overlap and repeat. An automaton of a block of names reads a text once, whatever the number of names; NAMES
    names are one block, which goes to every task. More names are dealt into blocks of that size, and each text meets each block in groups
    of at most about TEXT_BYTES. A null or empty name stands nowhere.
    """
    given = names.where("name <> ''").select("name_id", "name")
    blocks = max(1, -(-given.count() // NAMES))
    kinds = [f.dataType for f in (texts.schema["text_id"], names.schema["name_id"])]
    schema = T.StructType([T.StructField("text_id", kinds[0]), T.StructField("name_id", kinds[1])])
    x = texts.where("text <> ''").select("text_id", "text")
    if blocks == 1:
        held = [(r["name_id"], r["name"]) for r in given.collect()]  # at most NAMES rows

        def scan(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            reader = automaton(held)
            for part in parts:
                yield found_in(reader, part, schema)

        return x.mapInArrow(scan, schema).distinct()
    salts = max(1, -(-(x.agg(F.sum(F.octet_length("text"))).head()[0] or 0) // TEXT_BYTES))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = x.withColumn("salt", F.pmod(F.xxhash64("text_id", "text"), F.lit(salts)).cast("int")).withColumn("block", every(blocks))
    right = given.withColumn("block", F.pmod(F.xxhash64("name"), F.lit(blocks)).cast("int")).withColumn("salt", every(salts))

    def meet(a: pa.Table, b: pa.Table) -> pa.Table:
        reader = automaton(list(zip(b.column("name_id").to_pylist(), b.column("name").to_pylist(), strict=True)))
        return pa.Table.from_batches([found_in(reader, part, schema) for part in a.to_batches()], to_arrow_schema(schema))

    return left.groupBy("block", "salt").cogroup(right.groupBy("block", "salt")).applyInArrow(meet, schema).distinct()


def automaton(names: list[tuple]):
    """An Aho-Corasick automaton whose entries have their length and all ids of a name; null without names."""
    import ahocorasick

    out, ids = ahocorasick.Automaton(), {}
    for key, name in names:
        ids.setdefault(name, set()).add(key)
    for name, keys in ids.items():
        out.add_word(name, (len(name), keys))
    if ids:
        out.make_automaton()
    return out if ids else None


def found_in(reader, part: pa.RecordBatch, schema: T.StructType) -> pa.RecordBatch:
    """The names that stand in a batch's texts with no letter, digit or underscore on either side."""
    word = lambda c: c.isalnum() or c == "_"
    out: list[tuple] = []
    for key, text in zip(part.column("text_id").to_pylist(), part.column("text").to_pylist(), strict=True):
        held: set = set()
        for end, (size, keys) in reader.iter(text) if reader else ():
            if (end + 1 == len(text) or not word(text[end + 1])) and (end == size - 1 or not word(text[end - size])):
                held |= keys
        out += [(key, k) for k in held]
    arrow = to_arrow_schema(schema)
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], arrow.types[k]) for k in range(2)], schema=arrow)


def resolve_calls(calls: DataFrame, symbols: DataFrame, imports: DataFrame) -> DataFrame:
    """(caller, callee, confidence) for calls (caller, module, class, receiver, name) by three rules, the first that fits.

    self or class receiver in the same class 0.95; same module 0.95; a module imported under the receiver's name 0.8.
    Symbols are (symbol, module, class, name), imports (module, alias, target). A symbol does not call itself.
    """
    c = calls.withColumn("_call", F.xxhash64("caller", "name", "receiver"))
    own = c.where("class IS NOT NULL AND receiver IN ('self', 'cls', 'this')").join(symbols, ["module", "class", "name"]).select("_call", "caller", F.col("symbol").alias("callee"), F.lit(0).alias("rule"), F.lit(0.95).alias("confidence"))
    local = c.where("receiver IS NULL").join(symbols.where("class IS NULL").drop("class"), ["module", "name"]).select("_call", "caller", F.col("symbol").alias("callee"), F.lit(1).alias("rule"), F.lit(0.95).alias("confidence"))
    far = c.where("receiver IS NOT NULL").join(imports, (c["module"] == imports["module"]) & (c["receiver"] == imports["alias"])).select("_call", "caller", "name", F.col("target").alias("module"))
    via = far.join(symbols.where("class IS NULL").drop("class"), ["module", "name"]).select("_call", "caller", F.col("symbol").alias("callee"), F.lit(2).alias("rule"), F.lit(0.8).alias("confidence"))
    best = Window.partitionBy("_call").orderBy("rule", "callee")
    return own.unionByName(local).unionByName(via).where("caller <> callee").withColumn("_k", F.row_number().over(best)).where("_k = 1").select("caller", "callee", "confidence").distinct()


def endpoints(routes: DataFrame, components: DataFrame, handlers: DataFrame) -> DataFrame:
    """(endpoint, routes, components, handlers): what meets at METHOD:path on both sides of the stack."""
    key = lambda df, side, what: df.select(F.concat_ws(":", F.lit("endpoint"), F.upper("method"), F.col("path")).alias("endpoint"), F.lit(side).alias("side"), F.col(what).alias("id"))
    both = key(routes, "route", "id").unionByName(key(components, "component", "id"))
    served = routes.join(handlers.select(F.col("src").alias("id"), F.col("dst").alias("handler")), "id").select(F.concat_ws(":", F.lit("endpoint"), F.upper("method"), F.col("path")).alias("endpoint"), F.lit("handler").alias("side"), F.col("handler").alias("id"))
    pick = lambda side: F.array_join(F.sort_array(F.collect_set(F.when(F.col("side") == side, F.col("id").cast("string")))), ",")
    return both.unionByName(served).groupBy("endpoint").agg(pick("route").alias("routes"), pick("component").alias("components"), pick("handler").alias("handlers"))


def provenance(references: DataFrame, motivated: DataFrame, closed: DataFrame) -> DataFrame:
    """(symbol, memory, via): what explains a symbol, over the commits that touch it.

    references (commit_id, symbol), motivated (commit_id, memory), closed (memory, commit_id).
    """
    r = references.select("commit_id", "symbol")
    one = r.join(motivated, "commit_id").select("symbol", "memory", F.lit("motivated_by").alias("via"))
    two = r.join(closed, "commit_id").select("symbol", "memory", F.lit("closed_by").alias("via"))
    return one.unionByName(two).distinct()


def provenance_of(spans: DataFrame, hunks: DataFrame, motivated: DataFrame, closed: DataFrame) -> DataFrame:
    """(symbol, memory, via): `provenance` of the symbols that commits touch, for spans (file, symbol, a, b) and hunks (commit_id, file, a, b).

    Commits are replaced by their memories before ranges meet, so equal ranges of a memory meet the symbols once and no commit meets a symbol.
    """
    why = motivated.select("commit_id", "memory", F.lit("motivated_by").alias("via")).unionByName(closed.select("commit_id", "memory", F.lit("closed_by").alias("via")))
    ranges = hunks.join(why, "commit_id").select("memory", "via", "file", F.col("a").alias("c"), F.col("b").alias("d")).distinct()
    return overlaps(spans.select("file", "symbol", "a", "b").distinct(), ranges, "file").select("symbol", "memory", "via").distinct()


def fresh_evidence(stamps: DataFrame, touched: DataFrame) -> DataFrame:
    """(session, rule, fresh): a stamp counts while no file of its session was touched later."""
    last = touched.groupBy("session").agg(F.max("touched_at").alias("last"))
    return stamps.join(last, "session", "left").select("session", "rule", (F.col("stamped_at") >= F.coalesce("last", F.lit(float("-inf")))).alias("fresh"))


def nearest(wanted: DataFrame, have: DataFrame, keys: list[str], at: str) -> DataFrame:
    """For each wanted row (id, keys, at) the row of have (symbol, keys, at) with the nearest place; ties go to the smaller symbol.

    Wanted rows are asked by their distinct places. Both sides are sorted together, forwards and backwards: a place looks at the last known
    one on either side, both with a running window, so no pairs are made and a key of many rows costs no more than its sort.
    """
    known = have.groupBy(*keys, at).agg(F.min("symbol").alias("symbol")).select(*keys, at, F.struct(F.col(at).alias("there"), "symbol").alias("_h"), F.lit(False).alias("_w"))
    asked = wanted.select(*keys, at).distinct().select(*keys, at, F.lit(None).cast(known.schema["_h"].dataType).alias("_h"), F.lit(True).alias("_w"))
    running = lambda place: F.last("_h", ignorenulls=True).over(Window.partitionBy(*keys).orderBy(place, "_w").rowsBetween(Window.unboundedPreceding, 0))
    # A known place that is equal counts on both sides: it comes first in either order.
    both = known.unionByName(asked).select(*keys, at, "_w", running(F.col(at)).alias("_b"), running(F.col(at).desc()).alias("_a")).where("_w")
    far = lambda c: F.abs(F.col(at) - F.col(f"{c}.there"))
    pick = F.least(F.when(F.col("_b").isNotNull(), F.struct(far("_b").alias("d"), F.col("_b.symbol").alias("symbol"))), F.when(F.col("_a").isNotNull(), F.struct(far("_a").alias("d"), F.col("_a.symbol").alias("symbol"))))
    found = both.select(*keys, at, pick.alias("p")).where("p IS NOT NULL").select(*keys, at, F.col("p.symbol").alias("symbol"))
    return wanted.join(found, [*keys, at]).select("id", "symbol")


def callers(calls: DataFrame, most: int = 4) -> DataFrame:
    """(symbol, callers, ids): symbols with 1 to `most` distinct callers (src, dst); others are dropped by their count before any list is made."""
    distinct = calls.select("src", F.col("dst").alias("symbol")).distinct()
    few = distinct.groupBy("symbol").agg(F.count("*").alias("callers")).where(F.col("callers") <= most)
    return distinct.join(few, "symbol").groupBy("symbol", "callers").agg(F.array_join(F.sort_array(F.collect_list(F.col("src").cast("string"))), ",").alias("ids"))


def values_join(wanted: DataFrame, chunks: DataFrame) -> DataFrame:
    """(node_id, chunk_idx, embedding) of wanted pairs (node_id, chunk_idx); a pair that is asked for twice comes once."""
    return chunks.join(wanted.select("node_id", "chunk_idx").distinct(), ["node_id", "chunk_idx"]).select("node_id", "chunk_idx", "embedding")


def missing(have: DataFrame, seen: DataFrame, key: str) -> DataFrame:
    """Rows of have whose key is not among seen: deletion sweeps, unembedded nodes, unreferenced symbols."""
    return have.join(seen.select(key).distinct(), key, "left_anti")


def neighbours(edges: DataFrame, ids: DataFrame, nodes: DataFrame) -> DataFrame:
    """Existing nodes one edge away from ids (id), those left out."""
    near = edges.join(ids.select(F.col("id").alias("src")), "src").select(F.col("dst").alias("id")).unionByName(edges.join(ids.select(F.col("id").alias("dst")), "dst").select(F.col("src").alias("id"))).distinct()
    return nodes.join(near.join(ids.select("id"), "id", "left_anti"), "id", "left_semi")
