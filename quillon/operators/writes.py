"""Writes without a table format that merges: each returns the new table, keyed and idempotent."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.schema import KEYS


def upsert(current: DataFrame, fresh: DataFrame, key: tuple[str, ...], keep: tuple[str, ...] = (), order: str | None = None) -> DataFrame:
    """current with fresh rows in place of those with the same key; columns in `keep` hold the first value, null keys meet.

    One aggregation by key: of several fresh rows the last by `order` wins (without it the greatest by all columns).
    """
    columns = current.columns
    side = lambda df, k: df.select(*key, F.struct(F.lit(k).alias("_side"), *([F.col(order).alias("_order")] if order else []), *[F.col(c) for c in columns if c not in key]).alias("_row"))
    merged = side(current, 0).unionByName(side(fresh, 1)).groupBy(*key).agg(F.max("_row").alias("_new"), F.min("_row").alias("_old"))
    return merged.select([F.col(c) if c in key else F.col(f"_old.{c}" if c in keep else f"_new.{c}").alias(c) for c in columns])


def add_up(current: DataFrame, fresh: DataFrame, key: tuple[str, ...], sums: tuple[str, ...]) -> DataFrame:
    """Additive upsert: counters of equal keys are summed."""
    return current.select(*key, *sums).unionByName(fresh.select(*key, *sums)).groupBy(*key).agg(*[F.sum(c).cast("long").alias(c) for c in sums])


def delete(current: DataFrame, gone: DataFrame, on: dict[str, str]) -> DataFrame:
    """Rows of current whose columns meet none of gone's."""
    condition = None
    for mine, other in on.items():
        c = current[mine].eqNullSafe(gone[other])
        condition = c if condition is None else condition & c
    return current.join(gone, condition, "left_anti")


def delete_nodes(tables: dict[str, DataFrame], ids: DataFrame) -> dict[str, DataFrame]:
    """nodes without ids (column id), with the cascade to edges, chunks, terms and feedback."""
    out = dict(tables)
    for name, columns in {"nodes": ("id",), "edges": ("src_id", "dst_id"), "chunks": ("node_id",), "node_terms": ("node_id",), "node_lengths": ("node_id",), "feedback_event": ("node_id",)}.items():
        for c in columns:
            if name in out:
                out[name] = out[name].join(ids.select(F.col("id").alias("_gone")), F.col(c) == F.col("_gone"), "left_anti")
    return out


def rekey(nodes: DataFrame, moves: DataFrame) -> DataFrame:
    """New source_path by id (moves: id, source_path); hash and times stay."""
    m = moves.select("id", F.col("source_path").alias("_to"))
    return nodes.join(m, "id", "left").withColumn("source_path", F.coalesce("_to", "source_path")).select(nodes.columns)


def replace_group(current: DataFrame, fresh: DataFrame, group: str) -> DataFrame:
    """All rows of the groups in fresh are replaced (chunks of a node, layout of a scope)."""
    return current.join(fresh.select(F.col(group).alias("_g")).distinct(), F.col(group) == F.col("_g"), "left_anti").unionByName(fresh)


def backfill(nodes: DataFrame, sources: DataFrame) -> DataFrame:
    """Null project keys of nodes below a source with a key get that key; the deepest source wins."""
    from quillon.functions.text import ancestors

    inside = nodes.where("project_key IS NULL").select("id", F.explode(ancestors(F.col("source_path"))).alias("path"))
    keyed = inside.join(sources.where("project_key IS NOT NULL").select("path", F.col("project_key").alias("_key")), "path").groupBy("id").agg(F.max_by("_key", F.length("path")).alias("_key"))
    return nodes.join(keyed, "id", "left").withColumn("project_key", F.coalesce("project_key", "_key")).select(nodes.columns)


def set_where(df: DataFrame, condition: Column, **values: Column) -> DataFrame:
    """An update of some rows in place."""
    return df.withColumns({k: F.when(condition, v).otherwise(F.col(k)) for k, v in values.items()})


def key_of(table: str) -> tuple[str, ...]:
    return KEYS[table]
