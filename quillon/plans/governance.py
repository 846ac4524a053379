"""Rules over tool, file and intent context, and the gate with its evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillon.schema import MODALITY_RANK

RULE = "rule_id string, modality string, enforcement string, globs array<string>, intents array<string>, tools array<string>, tool_arg string, requires_step string, verify_command string, project_key string, base boolean"
#: Commands that only wrap another one. Fixed values.
WRAPPERS = ("uv run", "poetry run", "npx", "python -m", "pnpm", "yarn", "npm run")


def parse_rules(rules: DataFrame, json_col: str = "rule") -> DataFrame:
    """Rules from JSON texts; what is missing or wrong gets an open default."""
    j = F.from_json(json_col, "id string, modality string, enforcement string, applies_to struct<glob:array<string>,intent:array<string>,tool:array<string>,tool_arg_match:string>, requires_step string, verify struct<command:string>, project string, base boolean", {"mode": "PERMISSIVE"})
    r = rules.select(j.alias("j"))
    return r.select(
        F.col("j.id").alias("rule_id"), F.when(F.col("j.modality").isin(*MODALITY_RANK), F.col("j.modality")).otherwise("SHOULD").alias("modality"), F.coalesce("j.enforcement", F.lit("advise")).alias("enforcement"),
        *[F.coalesce(F.col(f"j.applies_to.{a}"), F.array().cast("array<string>")).alias(b) for a, b in (("glob", "globs"), ("intent", "intents"), ("tool", "tools"))],
        F.col("j.applies_to.tool_arg_match").alias("tool_arg"), F.col("j.requires_step").alias("requires_step"), F.col("j.verify.command").alias("verify_command"), F.col("j.project").alias("project_key"), F.coalesce("j.base", F.lit(False)).alias("base"),
    )


def glob_of(pattern: Column) -> Column:
    """A glob column as an anchored pattern."""
    return F.concat(F.lit("^"), F.replace(F.replace(F.regexp_replace(pattern, r"([.+^$(){}|\\\[\]])", r"\\$1"), F.lit("*"), F.lit(".*")), F.lit("?"), F.lit(".")), F.lit("$"))


def applies(path: str = "path", tags: str = "tags", tool: str = "tool", arg: str = "arg") -> Column:
    """Whether a rule's triggers fit a context's columns: no trigger is universal, else any one is enough."""
    universal = (F.size("globs") == 0) & (F.size("intents") == 0) & (F.size("tools") == 0)
    by_glob = F.exists("globs", lambda g: F.expr("true") & (F.regexp_like(F.col(path), glob_of(g)) | F.regexp_like(F.regexp_extract(path, "[^/]*$", 0), glob_of(g))))
    by_tool = F.array_contains("tools", F.col(tool)) & (F.col("tool_arg").isNull() | F.coalesce(F.regexp_like(F.col(arg), F.col("tool_arg")), F.lit(False)))
    return universal | F.coalesce(by_glob, F.lit(False)) | F.coalesce(F.arrays_overlap("intents", F.col(tags)), F.lit(False)) | F.coalesce(by_tool, F.lit(False))


def modality_rank() -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for kv in MODALITY_RANK.items() for x in kv])[F.col("modality")], F.lit(0))


def context_keys(path: str = "path", tags: str = "tags", tool: str = "tool") -> Column:
    """What a context can be looked up by: its tool, its tags, the names along its path and its extension."""
    p = F.coalesce(F.col(path), F.lit(""))
    marked = lambda mark, c: F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda x: F.concat(F.lit(mark), x))
    return F.array_distinct(F.array_compact(F.concat(F.array(F.concat(F.lit("t:"), F.col(tool))), marked("i:", F.col(tags)), marked("s:", F.split(p, "/")), F.array(F.concat(F.lit("e:"), F.regexp_extract(p, r"\.[^./]*$", 0))))))


def rule_keys() -> Column:
    """What a rule's triggers can be found by; null if one of its globs has neither a whole name nor an extension, or it has no trigger."""
    plain = lambda g: F.filter(F.split(g, "/"), lambda x: (x != "") & ~x.rlike(r"[*?]"))
    key = lambda g: F.when(F.size(plain(g)) > 0, F.concat(F.lit("s:"), F.get(F.sort_array(F.transform(plain(g), lambda x: F.struct((-F.length(x)).alias("n"), x.alias("x")))), F.lit(0))["x"])).when(g.rlike(r"\.[^./*?]+$"), F.concat(F.lit("e:"), F.regexp_extract(g, r"\.[^./*?]+$", 0)))
    globs = F.transform("globs", key)
    some = F.concat(F.transform("tools", lambda x: F.concat(F.lit("t:"), x)), F.transform("intents", lambda x: F.concat(F.lit("i:"), x)), F.array_compact(globs))
    return F.when((F.size(some) > 0) & ~F.exists(globs, lambda k: k.isNull()), F.array_distinct(some))


def active(contexts: DataFrame, rules: DataFrame, scope: list[str] | None = None, most_rules: int = 10_000, mandatory_only: bool = False) -> DataFrame:
    """(context columns, rule columns) that bind.

    Rules are found by an equality with a name, extension, tag or tool of a context, then their triggers are tried; a pair that meets by
    several keys is kept at the smallest. Rules without such a key (those for every context, and globs of wildcards alone) meet every
    context, in blocks of at most `most_rules` on the broadcast side.
    """
    r = rules if scope is None else rules.where(F.col("base") | F.col("project_key").isNull() | F.col("project_key").isin(*scope))
    if mandatory_only:
        r = r.where(F.col("modality").isin("MUST", "MUST_NOT"))
    keyed = r.withColumn("_rk", rule_keys())
    by_key = keyed.where("_rk IS NOT NULL").withColumn("_k", F.explode("_rk"))
    asked = contexts.withColumn("_ck", context_keys()).withColumn("_k", F.explode("_ck"))
    columns = [*contexts.columns, *rules.columns]
    out = asked.join(by_key, "_k").where(F.col("_k") == F.array_min(F.array_intersect("_ck", "_rk"))).where(applies()).select(columns)
    rest = keyed.where("_rk IS NULL").drop("_rk")
    blocks = max(1, -(-rest.count() // most_rules))
    for k in range(blocks):
        part = rest.where(F.pmod(F.xxhash64("rule_id"), F.lit(blocks)) == k) if blocks > 1 else rest
        out = out.unionByName(contexts.join(F.broadcast(part), applies(), "inner").select(columns))
    return out


def ranked(bound: DataFrame, by: str = "context_id", limit: int = 5) -> DataFrame:
    """The first `limit` rules of each context, the stricter first; a top-k report."""
    w = Window.partitionBy(by).orderBy(modality_rank().desc(), "rule_id")
    return bound.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)


def satisfies(verify: Column, run: Column) -> Column:
    """Some part of a command line, without its wrapper, starts with the verify command at a word's end."""
    squeeze = lambda c: F.trim(F.regexp_replace(c, r"\s+", " "))
    unwrap = lambda c: F.trim(F.regexp_replace(c, "^(" + "|".join(WRAPPERS) + r")( |$)", ""))
    want = squeeze(verify)
    return (want != "") & F.exists(F.split(run, r"&&|\|\||;|\|"), lambda p: (unwrap(squeeze(p)) == want) | F.startswith(unwrap(squeeze(p)), F.concat(want, F.lit(" "))) | (squeeze(p) == want) | F.startswith(squeeze(p), F.concat(want, F.lit(" "))))


def gate(bound: DataFrame, satisfied: DataFrame, by: str = "context_id") -> DataFrame:
    """(context_id, permission, rules): deny, ask or allow from bound rules and satisfied (session, rule_id, step)."""
    done = satisfied.select("session", "rule_id", F.col("step").alias("requires_step")).distinct()
    left = bound.where(F.col("enforcement").isin("block", "require-ack")).join(done, ["session", "rule_id", "requires_step"], "left_anti")
    hard = (F.col("enforcement") == "block") & (F.col("requires_step").isNull() | (F.col("requires_step") == "verify"))
    judged = left.groupBy(by).agg(F.max(hard).alias("hard"), F.array_join(F.sort_array(F.collect_set("rule_id")), ",").alias("rules"))
    return bound.select(by).distinct().join(judged, by, "left").select(by, F.when(F.col("hard").isNull(), "allow").when(F.col("hard"), "deny").otherwise("ask").alias("permission"), F.coalesce("rules", F.lit("")).alias("rules"))
