"""Settings, environment files, fixtures, and proposals for what to read."""

from __future__ import annotations

import json
import os
from dataclasses import asdict, dataclass, field, fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.plans.retrieve import Scoring
from quillon.sources.files import SKIP_DIRS, extension

#: Extensions that count as documents and as sources, least numbers for a proposal, nodes of a code file, files of a large project. Fixed values.
DOC_EXTENSIONS = ("md", "markdown", "txt", "pdf", "rst")
LEAST_DOCS, LEAST_CODE, CODE_NODES, LARGE_PROJECT = 3, 10, 2.5, 6_000
FUSIONS, ISOLATIONS = ("weighted_rrf", "bm25_lead", "weighted_sum"), ("strict", "boost")
TASK_CLASSES = ("structural", "provenance", "memory_recall")


@dataclass
class Settings:
    """What can be set, with defaults; `load` keeps every value in its bounds and ignores what it doesn't know."""

    scoring: dict[str, float] = field(default_factory=lambda: {k: getattr(Scoring(), k) for k in ("vector", "graph", "recency", "type", "project", "lexical")})
    k: int = 5
    budget_tokens: int = 800
    recency_days: float = 90.0
    isolation: str = "strict"
    isolation_penalty: float = 0.85
    requery_seconds: int = 300
    requery_cosine: float = 0.85
    requery_hits: int = 3
    fusion: str = "weighted_rrf"
    bm25_lead: float = 0.85
    rrf_k: int = 60
    rrf_bm25: float = 0.75
    rrf_vector: float = 0.25
    mmr: float = 0.7
    retune_least_queries: int = 30


#: Bounds of numbers.
_BOUNDS = {
    "k": (1, 200), "budget_tokens": (1, 10_000), "recency_days": (1.0, None), "isolation_penalty": (0.0, 1.0), "requery_seconds": (0, None), "requery_cosine": (0.0, 2.0), "requery_hits": (0, 100),
    "bm25_lead": (0.0, 1.0), "rrf_k": (1, None), "rrf_bm25": (0.0, None), "rrf_vector": (0.0, None), "mmr": (0.0, 1.0), "retune_least_queries": (1, None),
}
_CHOICES = {"fusion": FUSIONS, "isolation": ISOLATIONS}


def merged(raw: object) -> Settings:
    """Defaults with the known and well-formed values of a mapping."""
    out = Settings()
    for name, value in raw.items() if isinstance(raw, dict) else ():
        if name == "scoring" and isinstance(value, dict):
            out.scoring |= {k: float(x) for k, x in value.items() if k in out.scoring and isinstance(x, int | float) and not isinstance(x, bool)}
        elif name in _CHOICES and isinstance(value, str) and value.strip().lower() in _CHOICES[name]:
            setattr(out, name, value.strip().lower())
        elif name in _BOUNDS and isinstance(value, int | float) and not isinstance(value, bool):
            kind, (low, high) = type(getattr(out, name)), _BOUNDS[name]
            if kind is float or isinstance(value, int):
                value = kind(value) if low is None else max(low, kind(value))
                setattr(out, name, value if high is None else min(high, value))
    return out


def load(path: str) -> Settings:
    """Settings of a JSON file; one that is missing or can't be read gives the defaults."""
    try:
        with open(path, encoding="utf-8") as f:
            return merged(json.load(f))
    except (OSError, ValueError):
        return Settings()


def save(settings: Settings, path: str) -> None:
    """Whole file or none: it is written beside its place and moved there."""
    with open(f"{path}.tmp", "w", encoding="utf-8") as f:
        json.dump(asdict(settings), f, indent=2, sort_keys=True)
    os.replace(f"{path}.tmp", path)


def scoring(settings: Settings) -> Scoring:
    same = {f.name for f in fields(Scoring)}
    plain = {"fusion": settings.fusion, "rrf_k": settings.rrf_k, "rrf_bm25": settings.rrf_bm25, "rrf_vector": settings.rrf_vector, "lead": settings.bm25_lead, "penalty": settings.isolation_penalty if settings.isolation == "strict" else 1.0, "k": settings.k, "budget": settings.budget_tokens, "mmr": settings.mmr}
    return Scoring(**{k: v for k, v in (settings.scoring | plain).items() if k in same})


def environment(text: str) -> dict[str, str]:
    """KEY=VALUE lines of a file; blank lines, comments and lines without `=` are passed over, one pair of quotes goes."""
    out = {}
    for line in map(str.strip, text.splitlines()):
        key, found, value = line.partition("=")
        key, value = key.strip(), value.strip()
        if not line.startswith("#") and found and key:
            out[key] = value[1:-1] if len(value) >= 2 and value[0] == value[-1] and value[0] in "'\"" else value
    return out


def discovered(listing: DataFrame, home: str, note: str = "CLAUDE.md") -> DataFrame:
    """(path, kind, project_key) of a home folder's file paths (path): its note, and each project's memory folder."""
    base = home.rstrip("/")
    one = listing.where(F.col("path") == f"{base}/{note}").select("path", F.lit("claude_md").alias("kind"), F.lit(None).cast("string").alias("project_key"))
    key = F.regexp_extract("path", "^" + "".join("\\" + c if c in ".+*?[](){}^$|\\" else c for c in base) + "/projects/([^/]+)/memory/", 1)
    many = listing.select(key.alias("project_key")).where("project_key <> ''").distinct()
    return one.unionByName(many.select(F.concat(F.lit(f"{base}/projects/"), "project_key", F.lit("/memory")).alias("path"), F.lit("memory_dir").alias("kind"), "project_key")).distinct().orderBy("kind", "path")


def ignore_lines(files: DataFrame) -> DataFrame:
    """(folder, k, line) of ignore files (path relative to a root, text), each line as it reads from the root, in the order of folders."""
    folder = F.regexp_replace(F.regexp_replace("path", "[^/]*$", ""), "/$", "")
    lines = F.filter(F.transform(F.split("text", r"\r?\n"), lambda x: F.trim(x)), lambda x: (x != "") & ~F.startswith(x, F.lit("#")))
    f = files.where(F.col("path").rlike(r"(^|/)\.gitignore$")).select("path", folder.alias("folder"), F.posexplode(lines).alias("k", "line"))
    f = f.where(~F.arrays_overlap(F.split("folder", "/"), F.array(*[F.lit(x) for x in SKIP_DIRS])))
    below = F.concat("folder", F.lit("/"), F.regexp_replace("line", "^/+", ""))
    turned = F.concat(F.lit("!"), "folder", F.lit("/"), F.regexp_replace(F.substring("line", 2, 1 << 20), "^/+", ""))
    return f.select("folder", "k", F.when(F.col("folder") == "", F.col("line")).when(F.startswith("line", F.lit("!")), turned).otherwise(below).alias("line"))


def with_excludes(lines: list[str], exclude: str | None) -> list[str]:
    """Ignore lines and then a source's own, each once."""
    return list(dict.fromkeys(x.strip() for x in [*lines, *(exclude or "").split(",")] if x.strip()))


def proposals(files: DataFrame, code_extensions: tuple[str, ...], large: int = LARGE_PROJECT) -> DataFrame:
    """(kind, n, est_nodes, large) of a folder's file paths (path): documents from LEAST_DOCS files on, code from LEAST_CODE on."""
    ext = extension(F.col("path"))
    kept = files.where(~F.arrays_overlap(F.split(F.regexp_replace("path", "(^|/)[^/]*$", ""), "/"), F.array(*[F.lit(x) for x in SKIP_DIRS])))
    c = kept.agg(F.count_if(ext.isin(*DOC_EXTENSIONS)).alias("docs"), F.count_if(ext.isin(*[x for x in code_extensions if x not in DOC_EXTENSIONS])).alias("code"))  # one row
    both = F.array(
        F.when(F.col("docs") >= LEAST_DOCS, F.struct(F.lit("docs_dir").alias("kind"), F.col("docs").alias("n"), F.col("docs").alias("est_nodes"))),
        F.when(F.col("code") >= LEAST_CODE, F.struct(F.lit("code_repo").alias("kind"), F.col("code").alias("n"), F.floor(F.col("code") * CODE_NODES).alias("est_nodes"))),
    )
    return c.select(F.explode(F.array_compact(both)).alias("p"), (F.col("docs") + F.col("code") > large).alias("large")).select("p.*", "large")


def retrieval_fixture(spark: SparkSession, path: str) -> DataFrame:
    """Labelled prompts of a JSON array: (prompt, expect_source_contains, query_type, note, project_key)."""
    from quillon.plans.feedback import query_type

    raw = spark.read.schema("prompt string, expect_source_contains array<string>, query_type string, note string, project_key string").option("multiLine", True).json(path)
    return raw.withColumn("query_type", query_type(F.col("query_type")))


def task_fixture(spark: SparkSession, path: str) -> DataFrame:
    """Tasks of a JSON array; a class that is none of the three is an error."""
    from quillon.operators.store import checked

    raw = spark.read.schema("id string, cls string, prompt string, subject_key string, answer_keys array<string>, budget int, note string").option("multiLine", True).json(path)
    return checked(raw, "cls", TASK_CLASSES)


def bench_fixture(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(corpus, prompts with what is expected of them) of a folder with corpus.jsonl, prompts.json and expected.json.

    prompts.json lists prompts, as objects or, for the turns of one conversation, as plain texts (turn_1, turn_2, ...). expected.json
    has its answers by prompt id, or once for all turns, with the keywords of the last one. What is missing is empty, or 0.
    """
    top = folder.rstrip("/")
    whole = lambda name, schema: spark.read.text(f"{top}/{name}.json", wholetext=True).select(F.from_json("value", schema).alias("j")).select("j.*")
    corpus = spark.read.schema("id string, type string, name string, description string, body string, project_key string").json(f"{top}/corpus.jsonl")
    one = "relevant_node_ids array<string>, acceptance_criteria_keywords array<string>, rubric array<string>, expected_clarifications int"
    expected = whole("expected", f"invariant string, relevant_node_ids array<string>, required_keywords_final_turn array<string>, by_prompt map<string, struct<{one}>>")  # one row
    listed = whole("prompts", "prompts array<string>").select(F.size("prompts").alias("n"), F.posexplode("prompts").alias("k", "p"))
    said = lambda key: F.get_json_object("p", f"$.{key}")
    prompts = listed.select("n", "k", F.coalesce(said("id"), F.concat(F.lit("turn_"), F.col("k") + 1)).alias("prompt_id"), said("confidence").alias("confidence"), F.coalesce(said("text"), F.col("p")).alias("text"))
    j = prompts.crossJoin(F.broadcast(expected)).withColumn("e", F.try_element_at("by_prompt", F.col("prompt_id")))
    none = F.array().cast("array<string>")
    last = F.when(F.col("k") == F.col("n") - 1, F.col("required_keywords_final_turn"))
    return corpus, j.select(
        "prompt_id", "confidence", "text", F.coalesce("e.relevant_node_ids", "relevant_node_ids", none).alias("relevant"), F.coalesce("e.acceptance_criteria_keywords", last, none).alias("keywords"),
        F.coalesce("e.rubric", none).alias("rubric"), F.coalesce("e.expected_clarifications", F.lit(0)).alias("expected_clarifications"), F.coalesce("invariant", F.lit("")).alias("invariant"),
    )


def session_counts(log: DataFrame, now: int, seconds: int = 86_400) -> DataFrame:
    """(session_id, n): the latest count of each session (session_id, n, at) that is at most a day old; of two at one time the smaller."""
    return log.where(F.col("at") > now - seconds).groupBy("session_id").agg(F.max_by("n", F.struct("at", -F.col("n"))).alias("n"))
