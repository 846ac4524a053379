"""Plug-in points: tools, judges, query functions, memories. Each is a plain registry of callables over DataFrames."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RISKS = ("safe", "confirm", "danger")


@dataclass(frozen=True)
class Tool:
    """A named operation with its risk and argument schema."""

    name: str
    run: Callable[..., DataFrame]
    risk: str = "safe"
    arguments: dict[str, str] = field(default_factory=dict)


TOOLS: dict[str, Tool] = {}


def register(tool: Tool) -> Tool:
    if tool.risk not in RISKS:
        raise ValueError(f"risk is one of {RISKS}")
    if tool.name in TOOLS:
        raise ValueError(f"a tool named {tool.name} is registered")
    TOOLS[tool.name] = tool
    return tool


def call(name: str, confirmed: bool = False, **arguments) -> DataFrame:
    tool = TOOLS[name]
    if tool.risk != "safe" and not confirmed:
        raise PermissionError(f"{name} needs confirmation")
    unknown = set(arguments) - set(tool.arguments)
    if unknown:
        raise TypeError(f"{name} has no argument {sorted(unknown)}")
    return tool.run(**arguments)


class Memory(Protocol):
    """What a memory under evaluation offers."""

    def query(self, prompts: DataFrame) -> DataFrame: ...

    def feedback(self, events: DataFrame) -> None: ...


def judged(findings: DataFrame, judge: Callable[[DataFrame], DataFrame] | None) -> DataFrame:
    """Findings after a judge (fingerprint, confirmed): confirmed ones are high, rejected ones go, the others stay as they are."""
    if judge is None:
        return findings
    verdict = judge(findings).select("fingerprint", "confirmed")
    j = findings.join(verdict, "fingerprint", "left").where("confirmed IS NULL OR confirmed")
    return j.withColumn("severity", F.when(F.col("confirmed"), "high").otherwise(F.col("severity"))).select(findings.columns)


def solved(tasks: DataFrame, solve: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(task, key, calls) of a solver; one that raises finds nothing."""
    try:
        return solve(tasks)
    except Exception:  # noqa: BLE001  a failed callback counts as a miss
        return tasks.select("task", F.lit(None).cast("string").alias("key"), F.lit(0).alias("calls")).where("false")
