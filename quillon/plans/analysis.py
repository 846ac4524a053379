"""The audit as one plan: the detectors of a suite over the tables of a graph, and the queue that the cheap ones feed."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions.text import citations, concepts
from quillon.operators import audit, graph
from quillon.plans.registry import judged

#: Detectors that run without a lens, those of each lens, and those that run after every ingestion. Fixed values.
SUITE = ("stale", "duplicates", "orphan_references", "contradictions", "semantic_orphans")
LENSES = {"code": ("dead_code", "god_object", "cyclic_imports", "duplicate_code")}
PROACTIVE = ("stale", "orphan_references")
#: Node types of symbols that calls lead to.
CALLABLE = ("code_function", "code_method")


def requested(types: tuple[str, ...] | None = None, lens: str | None = None) -> list[str]:
    """Detectors to run, in order: a lens takes the place of the suite (an unknown one is empty), types choose within it."""
    suite = SUITE if lens is None else LENSES.get(lens, ())
    return [x for x in suite if not types or x in types]


def chosen(lens: Column, types: Column) -> Column:
    """The same for columns of requests."""
    names = lambda x: F.array(*map(F.lit, x)).cast("array<string>")
    suite = F.when(lens.isNull(), names(SUITE))
    for name, detectors in LENSES.items():
        suite = suite.when(lens == name, names(detectors))
    return F.filter(suite.otherwise(names(())), lambda x: types.isNull() | (F.size(types) == 0) | F.array_contains(types, x))


def _typed(t: dict[str, DataFrame]) -> DataFrame:
    return t["vectors"].join(t["nodes"].select("id", "type"), "id")


def _edges(t: dict[str, DataFrame], relation: str) -> DataFrame:
    return t["edges"].where(F.col("relation") == relation).select("src", "dst")


def _god(t: dict[str, DataFrame]) -> DataFrame:
    members = _edges(t, "method_of").select(F.col("dst").alias("owner"), F.col("src").alias("member")).unionByName(_edges(t, "defines").select(F.col("src").alias("owner"), F.col("dst").alias("member")))
    kind = F.when(F.col("type") == "code_class", "class").when(F.col("type") == "code_module", "module")
    return audit.god_objects(members, t["nodes"].select(F.col("id").alias("owner"), kind.alias("kind"), "name", "source_path").where("kind IS NOT NULL"))


DETECTORS: dict[str, Callable[[dict[str, DataFrame]], DataFrame]] = {
    "stale": lambda t: audit.stale(t["nodes"]),
    "duplicates": lambda t: audit.duplicates(_typed(t)),
    "orphan_references": lambda t: audit.orphan_citations(t["nodes"].select("id", F.explode(citations(F.coalesce("body", F.lit("")))).alias("target")), t["nodes"]),
    "contradictions": lambda t: audit.contradictions(_typed(t), t["nodes"]),
    "semantic_orphans": lambda t: audit.undefined_concepts(t["nodes"].select("id", F.explode(concepts(F.coalesce("body", F.lit("")))).alias("concept")), t["nodes"].select("id", "name", "description")),
    "dead_code": lambda t: audit.dead_code(t["nodes"].where(F.col("type").isin(*CALLABLE)), _edges(t, "calls")),
    "god_object": _god,
    "cyclic_imports": lambda t: audit.import_cycles(graph.cycles(_edges(t, "imports"))),
    "duplicate_code": lambda t: audit.duplicate_code(t["nodes"], t["vectors"]),
}


def analyze(tables: dict[str, DataFrame], types: tuple[str, ...] | None = None, lens: str | None = None, judges: dict[str, Callable[[DataFrame], DataFrame]] | None = None) -> DataFrame:
    """Fingerprinted findings of the chosen detectors, one union; a judge of a detector confirms (high) or drops its candidates.

    tables: nodes (id, type, name, description, body, source_path, project_key), edges (src, dst, relation), vectors (id, embedding).
    """
    runs = []
    for name in requested(types, lens):
        found = audit.fingerprint(DETECTORS[name](tables))
        runs.append(judged(found, (judges or {}).get(name)))
    if not runs:
        return audit.fingerprint(audit.stale(tables["nodes"].where("false")))
    return reduce(DataFrame.unionByName, runs)


def report(tables: dict[str, DataFrame], findings: DataFrame) -> DataFrame:
    """(type, n, scanned): findings by the names that reports use, with the number of nodes looked at."""
    return audit.tally(findings).crossJoin(F.broadcast(tables["nodes"].agg(F.count("*").alias("scanned"))))  # one row


def proactive(tables: dict[str, DataFrame], queue: DataFrame, now: int) -> DataFrame:
    """The queue after the detectors that need neither vectors nor a judge; each row with its change."""
    return audit.reconcile(queue, analyze(tables, PROACTIVE), ["stale", "orphan_reference"], now)
