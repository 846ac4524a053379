"""An inverted-file partition of vectors with centre and radius bounds: exact similarity joins and searches that skip cells.

Unit vectors are dealt to the nearest of some centres by angle. Angles obey the triangle inequality, so a vector within `t` of a
member of a cell is within `t` plus the cell's radius of its centre, and the angles of the two to that centre differ by at
most `t`. A join therefore copies a vector to the cells whose bound it meets only, cuts each cell into rings of width `t` around the
centre, and compares a ring to itself and its neighbours. A search takes the k-th best of the nearest cells as its bound and reads only the
other cells, and of those only the vectors, that can beat it. Nothing inside the bound is lost, whatever the centres are: they are fitted to a
bounded sample (the SAMPLE vectors with the least hashes) and only decide how much is skipped.

Cells of any size are cut into blocks of BLOCK_ROWS vectors, rings of a join into blocks of BLOCK_ROWS * JOIN_BLOCKS; a task multiplies two
blocks, and a join's pairs leave it step by step.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.operators.graph import saved, work_dir

#: Vectors of the sample that centres are fitted to, rounds of fitting, vectors that one centre should have, and most centres.
SAMPLE, ROUNDS, CELL_ROWS, MOST_CENTRES = 8192, 4, 4096, 1024
#: Vectors and queries that one block of a product holds, such blocks that one block of a join holds, and rows of it that are multiplied at once.
BLOCK_ROWS, QUERY_ROWS, JOIN_BLOCKS, STEP_ROWS = 2048, 2048, 8, 512
#: A join goes through cells where they leave at most this share of the pairs; else copies of vectors would cost more than they skip.
WORTH = 0.5
#: Radians by which bounds are widened, against rounding.
NEAR = 1e-6
_ROW = "id long, embedding array<double>, bucket string, mark boolean, cell int, angle double, visits boolean"


def unit(rows: list | np.ndarray) -> np.ndarray:
    """Rows of length 1; zero vectors stay zero."""
    x = np.array(rows, np.float64)
    norm = np.sqrt((x**2).sum(axis=1))
    return x / np.where(norm == 0, 1, norm)[:, None]


def centres(vectors: DataFrame, most: int = MOST_CENTRES) -> np.ndarray:
    """Centres for (id, embedding) by spherical means over a bounded sample; one for each CELL_ROWS vectors, from 1 to `most`."""
    n = vectors.count()
    held = vectors.select("embedding", F.xxhash64("id", "embedding").alias("_h")).orderBy("_h").limit(SAMPLE)
    x = unit([r["embedding"] for r in held.select("embedding").collect()]) if n else np.zeros((0, 1))  # at most SAMPLE rows
    k = max(1, min(most, -(-n // CELL_ROWS), len(x) // 8))
    c = x[:: max(1, len(x) // k)][:k] if len(x) else np.zeros((1, 1))
    for _ in range(ROUNDS if len(x) > k > 1 else 0):
        own = (x @ c.T).argmax(axis=1)
        sums = np.zeros_like(c)
        np.add.at(sums, own, x)
        norm = np.sqrt((sums**2).sum(axis=1, keepdims=True))
        c = np.where(norm > 1e-9, sums / np.maximum(norm, 1e-9), c)
    return c


def angles(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(x @ c.T, -1.0, 1.0))


def assigned(vectors: DataFrame, c: np.ndarray, reach: np.ndarray | None = None) -> DataFrame:
    """Rows of (id, embedding, bucket) in their home cells with the angle to the centre; with reach also in earlier cells within reach[cell], as visitors."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            if not part.num_rows:
                continue
            a = angles(unit(part.column("embedding").to_pylist()), c)
            home = a.argmin(axis=1)
            rows, cells = np.arange(len(home)), home
            if reach is not None:
                r, i = np.nonzero((a <= reach[None, :]) & (np.arange(len(c))[None, :] < home[:, None]))
                rows, cells = np.concatenate([rows, r]), np.concatenate([home, i])
            out = part.take(pa.array(rows))
            yield pa.RecordBatch.from_arrays([*out.columns, pa.array(cells, pa.int32()), pa.array(a[rows, cells]), pa.array(np.arange(len(rows)) >= len(home))], names=["id", "embedding", "bucket", "mark", "cell", "angle", "visits"])

    return vectors.select("id", "embedding", "bucket", "mark").mapInArrow(run, _ROW)


def radii(homes: DataFrame, k: int) -> np.ndarray:
    """The greatest angle of each cell's own vectors; -1 for an empty one."""
    out = np.full(k, -1.0)
    for r in homes.where("NOT visits").groupBy("cell").agg(F.max("angle").alias("r")).collect():  # one row for each centre
        out[r["cell"]] = r["r"]
    return out


def prepared(vectors: DataFrame, bucket: str | None, mark: str | None = None) -> DataFrame:
    """(id, embedding, bucket, mark): vectors of other sizes never meet, so the size is a part of the bucket."""
    e = F.col("embedding").cast("array<double>")
    name = F.concat_ws("|", F.size(e).cast("string"), F.col(bucket).cast("string") if bucket else F.lit(""))
    return vectors.where("embedding IS NOT NULL AND size(embedding) > 0").select(F.col("id").cast("long").alias("id"), e.alias("embedding"), name.alias("bucket"), (F.coalesce(F.col(mark), F.lit(False)) if mark else F.lit(True)).alias("mark"))


def _blocks(rows: DataFrame, width: float) -> tuple[DataFrame, DataFrame]:
    """rows with ring and block, and the units (bucket, cell, ring, visits, n, blocks) they stand in."""
    ringed = rows.withColumn("ring", F.floor(F.col("angle") / width).cast("int"))
    units = ringed.groupBy("bucket", "cell", "ring", "visits").agg(F.count("*").alias("n")).withColumn("blocks", F.ceil(F.col("n") / (BLOCK_ROWS * JOIN_BLOCKS)).cast("int"))
    key = ["bucket", "cell", "ring", "visits"]
    return ringed.join(units.drop("n"), key).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")), units


def _meetings(units: DataFrame) -> DataFrame:
    """Pairs of units that can hold a pair of vectors: a ring of a cell's own vectors with itself, the next one, and rings of visitors beside it."""
    side = lambda k: units.select("bucket", "cell", *[F.col(c).alias(f"{c}{k}") for c in ("ring", "visits", "n", "blocks")])
    both = side(1).where("NOT visits1").join(side(2), ["bucket", "cell"])
    return both.where("(NOT visits2 AND ring2 BETWEEN ring1 AND ring1 + 1) OR (visits2 AND abs(ring1 - ring2) <= 1)")


def pairs(vectors: DataFrame, low: float, high: float = 2.0, bucket: str | None = None, most: int = MOST_CENTRES, mark: str | None = None) -> DataFrame:
    """(a, b, cosine) of pairs in one bucket with low <= cosine <= high, a < b; vectors are (id, embedding[, bucket, mark]). Exact; a low of 0 or less skips nothing.

    With mark, a boolean column, only pairs with a marked end are given.
    """
    rows, units = _placed(vectors, low, bucket, most, mark)
    span = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    met = _meetings(units).drop("n1", "n2").withColumn("block1", span("blocks1")).withColumn("block2", span("blocks2"))
    met = met.where("visits2 OR ring1 <> ring2 OR block1 <= block2").withColumn("same", F.expr("NOT visits2 AND ring1 = ring2 AND block1 = block2"))
    met = met.withColumn("pair", F.concat_ws("|", "bucket", "cell", "ring1", "block1", F.col("visits2").cast("int"), "ring2", "block2"))
    on = lambda k: [rows[c] == met[c] for c in ("bucket", "cell")] + [rows[c] == met[f"{c}{k}"] for c in ("ring", "visits", "block")]
    give = lambda k, m: rows.join(m, on(k)).select("id", "embedding", "mark", "pair", F.lit(k).alias("side"), "same")
    copies = give(1, met).unionByName(give(2, met.where("NOT same")))

    def product(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(batches)
        side, ids, mark = (table.column(c).to_numpy() for c in ("side", "id", "mark"))
        x = unit(pc.list_flatten(table.column("embedding")).to_numpy().reshape(table.num_rows, -1))
        same = table.column("same")[0].as_py()
        left, right = np.flatnonzero(side == 1), np.flatnonzero(side == (1 if same else 2))
        y = x[right].T
        for at in range(0, len(left), STEP_ROWS):  # a block's pairs leave it step by step
            some = left[at : at + STEP_ROWS]
            cosine = x[some] @ y
            a, b = np.nonzero((cosine >= low) & (cosine <= high))
            one, two = ids[some][a], ids[right][b]
            keep = (one < two if same else one != two) & (mark[some][a] | mark[right][b])
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(one, two)[keep], pa.int64()), pa.array(np.maximum(one, two)[keep], pa.int64()), pa.array(cosine[a, b][keep], pa.float64())], names=["a", "b", "cosine"])

    return copies.groupBy("pair").applyInArrow(product, "a long, b long, cosine double")


def _placed(vectors: DataFrame, low: float, bucket: str | None, most: int, mark: str | None = None) -> tuple[DataFrame, DataFrame]:
    folder = work_dir(vectors.sparkSession)
    given = saved(prepared(vectors, bucket, mark), f"{folder}/vectors")
    theta = math.acos(max(-1.0, min(1.0, low))) + NEAR
    sizes = [r["size"] for r in given.select(F.size("embedding").alias("size")).distinct().limit(2).collect()]
    c = centres(given, most) if len(sizes) == 1 and theta < math.pi / 2 else None
    if c is not None and len(c) > 1:
        rows = assigned(given, c, radii(assigned(given, c), len(c)) + theta)
        if _work(_blocks(rows, theta)[1]) <= WORTH * _every(given):
            return _blocks(saved(rows, f"{folder}/cells"), theta)
    # Nothing can be skipped, or too little, or vectors of several sizes: one cell for each bucket.
    return _blocks(given.select("id", "embedding", "bucket", "mark", F.lit(0).alias("cell"), F.lit(0.0).alias("angle"), F.lit(False).alias("visits")), theta)


def _work(units: DataFrame) -> int:
    """Pairs of vectors that the meetings of units multiply."""
    done = F.when(F.expr("NOT visits2 AND ring1 = ring2"), F.expr("n1 * (n1 - 1) div 2")).otherwise(F.expr("n1 * n2"))
    return int(_meetings(units).agg(F.sum(done)).first()[0] or 0)


def _every(given: DataFrame) -> int:
    """Pairs of vectors of one bucket."""
    return int(given.groupBy("bucket").agg(F.count("*").alias("n")).agg(F.sum(F.expr("n * (n - 1) div 2"))).first()[0] or 0)


def compared(vectors: DataFrame, low: float, bucket: str | None = None, most: int = MOST_CENTRES) -> tuple[int, int]:
    """(pairs of vectors that a join multiplies, pairs of one bucket): what the bounds leave of the work."""
    _, units = _placed(vectors, low, bucket, most)
    return _work(units), _every(prepared(vectors, bucket))


class VectorCells:
    """A stored index of vectors (id, embedding), one folder for each cell; all of one size."""

    def __init__(self, vectors: DataFrame, folder: str | None = None, most: int = MOST_CENTRES):
        self.spark, self.folder = vectors.sparkSession, folder or work_dir(vectors.sparkSession)
        given = saved(prepared(vectors, None), f"{self.folder}/vectors")
        self.centres = centres(given, most)
        rows = assigned(given, self.centres)
        rows.drop("visits", "bucket", "mark").repartition("cell", F.pmod(F.xxhash64("id"), F.lit(8))).write.partitionBy("cell").parquet(f"{self.folder}/cells")
        self.cells = self.spark.read.schema("id long, embedding array<double>, angle double, cell int").parquet(f"{self.folder}/cells")
        self.radii = radii(self.cells.withColumn("visits", F.lit(False)), len(self.centres))

    def _asked(self, queries: DataFrame, pick) -> DataFrame:
        """(qid, vector, cell, far) of the cells that pick(angles to centres, bound) chooses for each query (qid, vector[, bound])."""
        c, schema = self.centres, "qid long, vector array<double>, cell int, far double, bound double"

        def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in parts:
                if part.num_rows:
                    a = angles(unit(part.column("vector").to_pylist()), c)
                    rows, cells = np.nonzero(pick(a, part.column("bound").to_numpy()))
                    held = part.take(pa.array(rows))
                    yield pa.RecordBatch.from_arrays([held.column("qid"), held.column("vector"), pa.array(cells, pa.int32()), pa.array(a[rows, cells]), held.column("bound")], names=["qid", "vector", "cell", "far", "bound"])

        return queries.select("qid", "vector", "bound").mapInArrow(run, schema)

    def _scored(self, asked: DataFrame, k: int) -> DataFrame:
        """(qid, id, cosine): the k best of each query in each block of each asked cell, and of those only what the ring's bound admits."""
        groups = max(1, -(-asked.select("qid").distinct().count() // QUERY_ROWS))
        sizes = self.cells.groupBy("cell").agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("blocks"))
        asked = asked.join(sizes, "cell").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("group", F.pmod(F.xxhash64("qid"), F.lit(groups)))
        wanted = asked.select(F.col("cell").alias("_c"), F.col("block").alias("_b"), F.col("group").alias("_g")).distinct()
        own = self.cells.join(sizes.select(F.col("cell").alias("_s"), F.col("blocks").alias("_n")), F.col("cell") == F.col("_s")).withColumn("_k", F.pmod(F.xxhash64("id"), F.col("_n")).cast("int"))
        held = own.join(wanted, (F.col("cell") == F.col("_c")) & (F.col("_k") == F.col("_b"))).select("id", "embedding", "angle", "_c", "_b", "_g")

        def product(a: pa.Table, b: pa.Table) -> pa.Table:
            out: list[tuple] = []
            if a.num_rows and b.num_rows:
                order = np.argsort(a.column("id").to_numpy(), kind="stable")
                ids, x, ring = a.column("id").to_numpy()[order], unit(a.column("embedding").to_pylist())[order], a.column("angle").to_numpy()[order]
                y, far, bound = unit(b.column("vector").to_pylist()), b.column("far").to_numpy(), b.column("bound").to_numpy()
                for at, qid in enumerate(b.column("qid").to_pylist()):
                    near = np.flatnonzero(np.abs(ring - far[at]) <= bound[at] + NEAR)
                    c = x[near] @ y[at]
                    for j in np.argsort(-np.round(c, 9), kind="stable")[:k]:
                        out.append((qid, int(ids[near[j]]), float(c[j])))
            columns = list(zip(*out, strict=True)) or [[], [], []]
            return pa.table({"qid": pa.array(columns[0], pa.int64()), "id": pa.array(columns[1], pa.int64()), "cosine": pa.array(columns[2], pa.float64())})

        return held.groupBy("_c", "_b", "_g").cogroup(asked.groupBy("cell", "block", "group")).applyInArrow(product, "qid long, id long, cosine double")

    def probed(self, queries: DataFrame, k: int, probes: int = 1) -> DataFrame:
        """(qid, id, cosine) of the nearest `probes` cells: approximate."""
        r = self.radii
        nearest = lambda a, _: np.argsort(np.argsort(np.where(r[None, :] >= 0, a, np.inf), axis=1, kind="stable"), axis=1, kind="stable") < probes
        asked = queries.where("vector IS NOT NULL").select(F.col("qid").cast("long").alias("qid"), F.col("vector").cast("array<double>").alias("vector"), F.lit(math.pi).alias("bound"))
        return self._scored(self._asked(asked, nearest), k)

    def candidates(self, queries: DataFrame, k: int, probes: int = 1) -> DataFrame:
        """(qid, id, cosine) with every exact neighbour in it: what the nearest cells gave, and of the others what their bounds can't rule out."""
        folder = work_dir(self.spark)
        first = saved(self.probed(queries, k, probes), f"{folder}/first")
        return first.unionByName(self._scored(self._open(queries, first, k), k)).groupBy("qid", "id").agg(F.max("cosine").alias("cosine"))

    def _open(self, queries: DataFrame, first: DataFrame, k: int) -> DataFrame:
        """The cells that the k-th best of `first` can't rule out; a query with fewer finds rules out none."""
        best = F.try_element_at(F.sort_array(F.collect_list("cosine"), asc=False), F.lit(k))
        bound = first.groupBy("qid").agg(best.alias("_c")).select("qid", F.when(F.col("_c").isNotNull(), F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("_c"))))).alias("bound"))
        asked = queries.where("vector IS NOT NULL").select(F.col("qid").cast("long").alias("qid"), F.col("vector").cast("array<double>").alias("vector")).join(bound, "qid", "left")
        r = self.radii
        every = lambda a, b: (a - r[None, :] <= b[:, None] + NEAR) & (r[None, :] >= 0)
        return self._asked(asked.withColumn("bound", F.coalesce("bound", F.lit(math.pi))), every)

    def cells_read(self, queries: DataFrame, k: int, probes: int = 1) -> tuple[int, int]:
        """(query and cell pairs that the bounds leave, all such pairs)."""
        return self._open(queries, self.probed(queries, k, probes), k).count(), queries.where("vector IS NOT NULL").count() * int((self.radii >= 0).sum())
