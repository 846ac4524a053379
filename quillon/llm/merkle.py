"""A Merkle manifest of a table of documents by paths of parents' preimages, in DataFrame functions only.

A leaf is the hash of a row's fields. Leaves of a language stand in order of doc_id; every `FAN` consecutive nodes have
a parent, whose preimage is their hashes one after another, 64 characters each, and whose hash is the preimage's. The
languages' top nodes are the leaves of one more tree of the same form. Each level's preimages are a written table. From the
top down, a node's path is its parent's preimage before its parent's path, so that a leaf gets all its ancestors' preimages by one join
of a level with the next one, an eighth of its size; it then cuts its own slot of 64 characters out of each for the siblings,
and for folding puts the hash so far into that slot and hashes what results.

`manifest` gives every leaf with its path; `proved` its proof and the root that a replaced leaf folds to.

Defined results: a null field is `-`, an empty one `0:`; leaves with one doc_id stand in order of their hashes, so that equal
rows share the places; a null doc_id stands first in its language; a lone leaf is its
language's top node and a lone language's top node is the root; an empty table has no leaves and no root. Other columns of the input are ignored.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.base import crc32_sql, shared_dir, stored
from quillon.llm.ranks import ranked, same

#: Children of a node, and characters of a hash. Fixed by the contract.
FAN, WIDE = 8, 64
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
PATH = "array<struct<slot:int,preimage:string>>"


def leaf_hash(values: list[Column]) -> Column:
    """The hash of fields, each `-` where null, else its number of UTF-8 bytes, a colon and itself."""
    text = [v.cast("string") for v in values]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-")) for v in text]).cast("binary"), 256)


def lowered(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def leaves(docs: DataFrame, fields: tuple[str, ...] = FIELDS, group: str = "lang", tampered: Column | None = None) -> DataFrame:
    """(doc_id, key, leaf, other): other is the leaf of the tampered row, null where the row isn't tampered with."""
    values = [F.col(f) for f in fields]
    other = F.lit(None).cast("string") if tampered is None else F.when(tampered, leaf_hash([*values[:-1], lowered(values[-1])]))
    return docs.select(F.col(fields[0]).alias("doc_id"), F.col(group).alias("key"), leaf_hash(values).alias("leaf"), other.alias("other"))


def _hash(preimage: Column) -> Column:
    return F.sha2(preimage.cast("binary"), 256)


class Tree:
    """The trees over nodes (key, rank, hash, ...), one for each key.

    levels[k], a written table, has (key, at, preimage, n) of the parents at height k + 1 in trees of more than one node at height k; n
    is the number of nodes of the key at that height. tops has (key, top) of every key.
    """

    def __init__(self, nodes: DataFrame, folder: str):
        sizes = nodes.groupBy("key").agg((F.max("rank") + 1).alias("n"))
        left = sizes.agg(F.max("n")).head()[0] or 0
        self.nodes = nodes.join(sizes.withColumnRenamed("key", "_key"), same(F.col("key"), F.col("_key"))).drop("_key")
        self.levels: list[DataFrame] = []
        level = self.nodes.select("key", F.col("rank").alias("at"), "hash", "n")
        tops = [level.where("n = 1").select("key", F.col("hash").alias("top"))]
        while left > 1:
            ordered = F.transform(F.sort_array(F.collect_list(F.struct("at", "hash"))), lambda x: x["hash"])
            run = level.where("n > 1").groupBy("key", F.expr(f"at div {FAN}").alias("at")).agg(F.array_join(ordered, "").alias("preimage"), F.first("n").alias("n"))
            run = stored(run.withColumn("n", F.expr(f"(n + {FAN - 1}) div {FAN}")), f"{folder}-{len(self.levels) + 1}")
            self.levels.append(run)
            level = run.select("key", "at", _hash(F.col("preimage")).alias("hash"), "n")
            tops.append(level.where("n = 1").select("key", F.col("hash").alias("top")))
            left = -(-left // FAN)
        self.tops = functools.reduce(DataFrame.unionByName, tops)

    def paths(self, above: DataFrame) -> DataFrame:
        """nodes with `path`, from the parent up and on with what `above` (key, path, ...) has for the key's top node."""
        more = [c for c in above.columns if c not in ("key", "path")]
        top = above.select(F.col("key").alias("_key"), "path", *more)
        over = None
        for level in [*reversed(self.levels), self.nodes.withColumnRenamed("rank", "at")]:
            held = level.where("n = 1").join(top, same(F.col("key"), F.col("_key"))).drop("_key")
            if over is not None:
                step = F.struct((F.col("at") % FAN).cast("int").alias("slot"), F.col("_preimage").alias("preimage"))
                below = level.where("n > 1").join(over, same(F.col("key"), F.col("_key")) & (F.expr(f"at div {FAN}") == F.col("_at")))
                held = held.unionByName(below.withColumn("path", F.concat(F.array(step), "path")).drop("_key", "_at", "_preimage"))
            if level.columns[:3] == ["key", "at", "preimage"]:
                over = held.select(F.col("key").alias("_key"), F.col("at").alias("_at"), F.col("preimage").alias("_preimage"), "path", *more)
        return held.withColumnRenamed("at", "rank")


def manifest(docs: DataFrame, tampered: Column | None = None) -> DataFrame:
    """(doc_id, key, rank, leaf, other, path, subroot, root) of every row; path is from the leaf's parent to the root."""
    folder = shared_dir(docs.sparkSession)
    placed = ranked(leaves(docs, tampered=tampered), ["key"], ["doc_id", "leaf"], f"{folder}/leaves")
    trees = Tree(placed.withColumn("hash", F.col("leaf")), f"{folder}/level")
    keys = ranked(trees.tops.withColumn("all", F.lit(0)), ["all"], ["key"], f"{folder}/keys").withColumnRenamed("key", "name")
    crown = Tree(keys.select(F.col("all").alias("key"), "rank", F.col("top").alias("hash"), "name"), f"{folder}/crown")
    start = crown.tops.select("key", F.array().cast(PATH).alias("path"), F.col("top").alias("root"))
    above = stored(crown.paths(start).select(F.col("name").alias("key"), "path", F.col("hash").alias("subroot"), "root"), f"{folder}/above")
    return trees.paths(above).select("doc_id", "key", "rank", "leaf", "other", "path", "subroot", "root")


def siblings(path: Column) -> Column:
    """The preimages without the path's own slots."""
    return F.transform(path, lambda x: F.concat(F.substr(x["preimage"], F.lit(1), x["slot"] * WIDE), F.substr(x["preimage"], x["slot"] * WIDE + (WIDE + 1))))


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and a path give: the hash so far replaces the slot of each preimage, which is hashed anew."""
    return F.aggregate(path, leaf, lambda h, x: _hash(F.concat(F.substr(x["preimage"], F.lit(1), x["slot"] * WIDE), h, F.substr(x["preimage"], x["slot"] * WIDE + (WIDE + 1)))))


def proved(made: DataFrame) -> DataFrame:
    """What the contract asks for."""
    fold = folded(F.coalesce("other", "leaf"), F.col("path"))
    got = made.select("doc_id", "leaf", "subroot", "root", _hash(F.array_join(siblings(F.col("path")), "")).alias("proof_sha256"), fold.alias("folded_root"))
    return got.withColumn("verified", F.col("folded_root") == F.col("root"))


def one_in_three(doc_id: Column) -> Column:
    """The contract's rows that are tampered with; a null id's row isn't."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 0, F.lit(False))


#: Tampering is looked up by crc32, written out for DuckDB.
ORACLE = """
WITH RECURSIVE f AS (
  SELECT doc_id, lang, source, n_chars, text, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low FROM documents
), g AS (
  SELECT doc_id, lang, coalesce(octet_length(doc_id::VARCHAR::BLOB) || ':' || doc_id, '-') || coalesce(octet_length(source::BLOB) || ':' || source, '-')
         || coalesce(octet_length(lang::BLOB) || ':' || lang, '-') || coalesce(octet_length(n_chars::VARCHAR::BLOB) || ':' || n_chars, '-') AS head,
         coalesce(octet_length(encode(text)) || ':' || text, '-') AS body, coalesce(octet_length(encode(low)) || ':' || low, '-') AS other FROM f
), l AS (SELECT doc_id, lang, sha256(head || body) AS leaf, sha256(head || other) AS other, coalesce(lang, chr(0)) AS k FROM g),
r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY doc_id NULLS FIRST, leaf) - 1 AS rank, count(*) OVER (PARTITION BY k) AS n FROM l),
t(k, h, at_, hash, n) AS (
  SELECT k, 0, rank::BIGINT, leaf, n::BIGINT FROM r
  UNION ALL SELECT k, h + 1, at_ // 8, sha256(string_agg(hash, '' ORDER BY at_)), any_value((n + 7) // 8) FROM t WHERE n > 1 GROUP BY k, h, at_ // 8
), s AS (SELECT k, hash AS subroot, row_number() OVER (ORDER BY k) - 1 AS rank, count(*) OVER () AS n, h AS depth FROM t WHERE n = 1),
c(h, at_, hash, n) AS (
  SELECT 0, rank::BIGINT, subroot, n::BIGINT FROM s
  UNION ALL SELECT h + 1, at_ // 8, sha256(string_agg(hash, '' ORDER BY at_)), any_value((n + 7) // 8) FROM c WHERE n > 1 GROUP BY h, at_ // 8
), p AS (
  SELECT k, h, at_ // 8 AS at_, list(hash ORDER BY at_) AS kids FROM t WHERE n > 1 GROUP BY k, h, at_ // 8
), q AS (SELECT h, at_ // 8 AS at_, list(hash ORDER BY at_) AS kids FROM c WHERE n > 1 GROUP BY h, at_ // 8),
steps AS (
  SELECT r.k, r.rank, p.h, (r.rank // (8 ** p.h)::BIGINT % 8)::BIGINT AS slot, p.kids FROM r JOIN p ON r.k = p.k AND p.at_ = r.rank // (8 ** (p.h + 1))::BIGINT
  UNION ALL SELECT r.k, r.rank, s.depth + q.h, (s.rank // (8 ** q.h)::BIGINT % 8)::BIGINT, q.kids FROM r JOIN s ON r.k = s.k JOIN q ON q.at_ = s.rank // (8 ** (q.h + 1))::BIGINT
), sib AS (
  SELECT k, rank, h, slot, coalesce(array_to_string(kids[1:slot], ''), '') AS pre, coalesce(array_to_string(kids[slot + 2:], ''), '') AS post FROM steps
), proof AS (SELECT k, rank, sha256(string_agg(pre || post, '' ORDER BY h)) AS proof FROM sib GROUP BY k, rank),
fold(k, rank, h, hash) AS (
  SELECT k, rank, 0, CASE WHEN {crc} % 3 = 0 THEN other ELSE leaf END FROM r
  UNION ALL SELECT fold.k, fold.rank, fold.h + 1, sha256(pre || hash || post) FROM fold JOIN sib ON fold.k = sib.k AND fold.rank = sib.rank AND fold.h = sib.h
), last AS (SELECT k, rank, arg_max(hash, h) AS folded FROM fold GROUP BY k, rank),
root AS (SELECT hash AS root FROM c WHERE n = 1)
SELECT r.doc_id, r.leaf, s.subroot, root.root, coalesce(proof.proof, sha256('')) AS proof_sha256, last.folded AS folded_root, last.folded = root.root AS verified
FROM r JOIN s ON r.k = s.k JOIN last ON r.k = last.k AND r.rank = last.rank LEFT JOIN proof ON r.k = proof.k AND r.rank = proof.rank CROSS JOIN root
""".replace("{crc}", f"coalesce({crc32_sql('doc_id::VARCHAR')}, 1)")
