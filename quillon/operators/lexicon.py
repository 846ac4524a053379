"""Nodes with a stored inverted index over name, description and body that is kept in lockstep.

A write puts the batch's nodes, their postings and their lengths into one epoch, so the index never disagrees with the nodes. Removed and
rewritten nodes need no change of old postings: these are passed over since their id was touched later. Ranking reads postings and
lengths only, and of the postings only the buckets and terms that the prompts have; no text is split again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.functions.text import BODY_CAP, search_tokens
from quillon.operators import ranking
from quillon.operators.epochs import Epochs

#: Folders over which the terms of an epoch are dealt, and postings of one batch.
BUCKETS, ROWS = 64, 1 << 16
#: Okapi constants, and the number of prompts' terms that are looked up as a set; more are joined.
K1, B, MOST_TERMS = ranking.K1, ranking.B, 20_000


def bucket(term):
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def fields(nodes: DataFrame):
    """A node's name, description and capped body as one text in lower case, which ends in a blank; no term stands across two of them."""
    field = lambda c: F.lower(F.coalesce(c, F.lit("")))
    return F.concat(field(F.col("name")), F.lit(" "), field(F.col("description")), F.lit(" "), field(F.substring("body", 1, BODY_CAP)), F.lit(" "))


def posted(texts: DataFrame) -> DataFrame:
    """(id, term, tf) of (id, text) with texts as of `fields`, each id once: terms are cut from bytes and counted by blocks of texts, no list of words is a row."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in ranking.slices(parts):
            words, ends = ranking.split(part.column("text"))
            if len(words):
                of = words.dictionary_encode()
                pair, tf = np.unique(np.repeat(np.arange(part.num_rows), np.diff(ends)) * len(of.dictionary) + of.indices.to_numpy(), return_counts=True)
                made = pa.RecordBatch.from_arrays([part.column("id").take(pa.array(pair // len(of.dictionary))), of.dictionary.take(pa.array(pair % len(of.dictionary))), pa.array(tf, pa.int64())], names=["id", "term", "tf"])
                yield from (made.slice(at, ROWS) for at in range(0, made.num_rows, ROWS))

    return texts.mapInArrow(run, T.StructType([texts.schema["id"], T.StructField("term", T.StringType()), T.StructField("tf", T.LongType())]))


def counted(split: DataFrame) -> DataFrame:
    """(id, term, tf) of (id, w), each id once: runs of equal terms of the sorted list, so that no term is shuffled."""
    of = split.where(F.size("w") > 0).select("id", F.sort_array("w").alias("w"))
    starts = F.filter(F.sequence(F.lit(0), F.size("w") - 1), lambda i: (i == 0) | (F.get("w", i) != F.get("w", i - 1)))
    runs = of.select("id", "w", starts.alias("s"))
    each = F.transform("s", lambda at, k: F.struct(F.get("w", at).alias("term"), (F.coalesce(F.get("s", k + 1), F.size("w")) - at).cast("long").alias("tf")))
    return runs.select("id", F.explode(each).alias("t")).select("id", "t.term", "t.tf")


class IndexedNodes:
    """A node table (id, name, description, body, more) and its index in one folder.

    columns: DDL of the node table. Of two rows with one id in a batch the greater one is kept; an id that is removed and written in
    one batch is written; null ids are not kept.
    """

    def __init__(self, spark: SparkSession, folder: str, columns: str):
        key = next(c.strip().split(" ", 1)[1] for c in columns.split(",") if c.strip().split(" ", 1)[0] == "id")
        self.names = [c.strip().split(" ", 1)[0] for c in columns.split(",")]
        self.store = Epochs(spark, folder, {"nodes": columns, "ids": f"id {key}, gone boolean, dl long", "postings": f"id {key}, term string, tf long, bucket int"}, {"postings": "bucket"})

    def write(self, nodes: DataFrame, gone: DataFrame | None = None, epoch: int | None = None) -> bool:
        """Upsert nodes and remove the ids of `gone`, as one epoch; the next one unless the caller names it."""
        rest = [c for c in self.names if c != "id"]
        fresh = nodes.where("id IS NOT NULL").groupBy("id").agg(F.max(F.struct(*rest)).alias("_r")).select("id", *[F.col(f"_r.{c}").alias(c) for c in rest])

        def split(read) -> DataFrame:  # the written nodes, so that texts are shuffled once
            return (n := read("nodes")).select("id", fields(n).alias("text"))

        def ids(read) -> DataFrame:
            made = split(read).select("id", F.lit(False).alias("gone"), F.regexp_count("text", F.lit("[a-z0-9_]{3,}")).cast("long").alias("dl"))
            if gone is None:
                return made
            lost = gone.where("id IS NOT NULL").select("id").distinct().join(read("nodes").select("id"), "id", "left_anti")
            return made.unionByName(lost.select("id", F.lit(True).alias("gone"), F.lit(0).cast("long").alias("dl")))

        def postings(read) -> DataFrame:
            return posted(split(read)).withColumn("bucket", bucket(F.col("term")))

        return self.store.write(self.store.last() + 1 if epoch is None else epoch, {"nodes": fresh, "ids": ids, "postings": postings})

    def nodes(self) -> DataFrame:
        return self.store.current("nodes").drop("epoch")

    def lengths(self) -> DataFrame:
        """(id, dl) of the nodes that are there."""
        return self.store.current("ids").where("NOT gone").select("id", "dl")

    def postings(self) -> DataFrame:
        return self.store.current("postings").drop("epoch")

    def compact(self) -> None:
        self.store.compact()

    def bm25(self, prompts: DataFrame, k: int | None = None) -> DataFrame:
        """(qid, id, score) for prompts (qid, prompt), from postings and lengths; with k, of each prompt at least the k best, ids being longs."""
        wanted = prompts.select("qid", F.explode(F.array_distinct(search_tokens(F.col("prompt")))).alias("term"))
        few = [r["term"] for r in wanted.select("term").distinct().limit(MOST_TERMS + 1).collect()]  # at most MOST_TERMS + 1 words
        asked = None if k is None else wanted.select(F.col("qid").cast("long").alias("qid"), "term").distinct().limit(ranking.MOST_WANTED + 1).toArrow()
        asked = None if asked is None or asked.num_rows > ranking.MOST_WANTED else asked
        p = self.postings()
        if len(few) <= MOST_TERMS:
            held = [r[0] for r in prompts.sparkSession.createDataFrame([(t,) for t in few], "term string").select(bucket(F.col("term"))).distinct().collect()]  # at most BUCKETS numbers
            p = p.where(F.col("bucket").isin(*held) & F.col("term").isin(*few))
        elif asked is not None:  # at most MOST_WANTED words, so the postings of all terms are not shuffled
            p = p.join(F.broadcast(prompts.sparkSession.createDataFrame(pa.table({"term": pc.unique(asked["term"])}))), "term", "left_semi")
        else:
            p = p.join(wanted.select("term").distinct(), "term", "left_semi")
        lengths = self.lengths()
        stats = lengths.agg(F.count("*").alias("n"), F.avg("dl").alias("mean"))  # one row
        df = p.groupBy("term").agg(F.count("*").alias("df"))
        if asked is not None:
            n, mean = stats.first()
            of = p.groupBy("id").agg(F.collect_list(F.struct("term", "tf")).alias("x")).join(lengths, "id")
            return ranking.best(of.select("id", "dl", F.col("x.term").alias("w"), F.col("x.tf").alias("tf")), asked, df.toArrow(), n, mean or 1.0, k)
        joined = p.join(df, "term").join(lengths, "id").join(wanted, "term").crossJoin(F.broadcast(stats))
        idf = F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
        part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("mean")))
        return joined.groupBy("qid", "id").agg(F.sum(part).alias("score"))


class ChunkStore:
    """Chunks (id, chunk_idx, chunk_text, embedding) of nodes in one folder; a node's chunks are replaced as a whole.

    A write is an epoch of its nodes' chunks only. A vector whose size isn't `dimensions` is an error and nothing is committed; a null
    vector is a chunk that is still to be embedded. Of two rows with one id and chunk_idx the greater one is kept.
    """

    def __init__(self, spark: SparkSession, folder: str, dimensions: int, key: str = "long"):
        self.dimensions = dimensions
        self.store = Epochs(spark, folder, {"chunks": f"id {key}, chunk_idx int, chunk_text string, embedding array<float>", "ids": f"id {key}"})

    def replace(self, chunks: DataFrame, nodes: DataFrame | None = None, epoch: int | None = None) -> bool:
        """The chunks of all ids in `chunks`, and of `nodes` (id), become those in `chunks`: a node without rows there has none."""
        fits = F.col("embedding").isNull() | (F.size("embedding") == self.dimensions)
        wrong = F.raise_error(F.concat(F.lit(f"a vector has not {self.dimensions} dimensions but "), F.size("embedding").cast("string")))
        rows = chunks.where("id IS NOT NULL").groupBy("id", "chunk_idx").agg(F.max(F.struct("chunk_text", "embedding")).alias("r")).select("id", "chunk_idx", "r.chunk_text", "r.embedding")
        checked = rows.withColumn("embedding", F.when(fits, F.col("embedding")).otherwise(wrong.cast("array<float>")))
        ids = rows.select("id") if nodes is None else rows.select("id").unionByName(nodes.where("id IS NOT NULL").select("id"))
        return self.store.write(self.store.last() + 1 if epoch is None else epoch, {"chunks": checked, "ids": ids.distinct()})

    def chunks(self) -> DataFrame:
        return self.store.current("chunks").drop("epoch")

    def compact(self) -> None:
        self.store.compact()
