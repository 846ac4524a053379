"""Exported commit logs and diffs, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What the log has to be exported with: `git log --format='%H%x1f%an%x1f%at%x1f%s%x1f%b%x1e'`.
FIELDS = ("sha", "author", "at", "subject", "body")


def read_log(spark: SparkSession, path: str, limit: int = 10_000) -> DataFrame:
    """(sha, author, at, subject, body), the newest `limit` commits."""
    rows = spark.read.option("lineSep", "\x1e").text(path).select(F.split(F.regexp_replace("value", r"^\s+", ""), "\x1f", -1).alias("f")).where(F.size("f") >= len(FIELDS))
    return rows.select(*[F.trim(F.get("f", F.lit(k))).cast("long" if n == "at" else "string").alias(n) for k, n in enumerate(FIELDS)]).orderBy(F.desc("at"), "sha").limit(limit)


def hunks(diff: Column) -> Column:
    """[(file, a, b)] of a diff without context lines: touched lines of the new file, pure deletions left out."""
    files = F.filter(F.split(diff, r"(?m)^\+\+\+ "), lambda x, k: k > 0)

    def of_file(x: Column) -> Column:
        name = F.regexp_replace(F.regexp_extract(x, r"\A([^\n\t]+)", 1), "^b/", "")
        heads = F.regexp_extract_all(x, F.lit(r"(?m)^(@@ -[0-9,]+ \+[0-9]+(?:,[0-9]+)? @@)"), F.lit(1))
        size = lambda h: F.coalesce(F.nullif(F.regexp_extract(h, r"\+[0-9]+,([0-9]+)", 1), F.lit("")).cast("long"), F.lit(1))
        start = lambda h: F.regexp_extract(h, r"\+([0-9]+)", 1).cast("long")
        return F.transform(F.filter(heads, lambda h: size(h) > 0), lambda h: F.struct(name.alias("file"), start(h).alias("a"), (start(h) + size(h) - 1).alias("b")))

    return F.filter(F.flatten(F.transform(files, of_file)), lambda r: r["file"] != "/dev/null")


def commit_nodes(log: DataFrame, project_key: str | None = None) -> DataFrame:
    return log.select(F.col("sha").alias("id"), F.lit("commit").alias("type"), F.concat(F.substring("sha", 1, 7), F.lit(" "), F.substring("subject", 1, 80)).alias("name"), F.col("subject").alias("description"), "body", F.lit(project_key).alias("project_key"), F.col("at").alias("updated_at"))
