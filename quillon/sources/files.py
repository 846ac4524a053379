"""File trees and documents as tables."""

from __future__ import annotations

import io
import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions.text import ignored, truthy

#: Folders of a code repository that are not read. Fixed values.
SKIP_DIRS = ("node_modules", ".git", "dist", "build", "__pycache__", ".venv", "venv", "target")
#: Extension -> language of code files. Fixed values.
LANGUAGES = {
    "py": "python", "pyi": "python", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript", "ts": "typescript", "tsx": "tsx", "go": "go", "json": "json", "jsonc": "json",
    "yaml": "yaml", "yml": "yaml", "md": "markdown", "markdown": "markdown", "rs": "rust", "java": "java", "c": "c", "h": "c", "cpp": "cpp", "cc": "cpp", "cxx": "cpp", "hpp": "cpp", "hxx": "cpp",
    "rb": "ruby", "php": "php", "cs": "c_sharp", "kt": "kotlin", "kts": "kotlin", "swift": "swift", "sh": "bash", "bash": "bash", "zsh": "bash",
}
_DOCUMENTS = ["**/*.md", "**/*.markdown", "**/*.txt", "**/*.pdf"]
#: Source kind -> globs that it reads without its own list; a kind without globs reads nothing, and a claude_md is one file. Fixed values.
INCLUDES = {"memory_dir": _DOCUMENTS, "plan_dir": _DOCUMENTS, "transcripts": _DOCUMENTS, "code_repo": [f"**/*.{e}" for e in sorted(LANGUAGES)]}


#: Types that a document's header may name, with or without `memory_`. Fixed values.
NODE_TYPES = (
    "memory_user", "memory_feedback", "memory_project", "memory_reference", "project_doc", "plan_doc", "session_summary", "rule", "commit",
    "code_module", "code_function", "code_class", "code_method", "code_route", "code_component", "code_endpoint",
)


def patterns(raw: str | None) -> list[str]:
    """A comma separated list of globs."""
    return [p.strip() for p in (raw or "").split(",") if p.strip()]


def wanted(path: Column, kind: str, include: str | None = None, exclude: str | None = None) -> Column:
    """Whether a source of a kind reads a relative path; globs have the meaning of an ignore file's lines."""
    keep = ignored(path, patterns(include) or INCLUDES.get(kind, [])) & ~ignored(path, patterns(exclude)) & (F.regexp_extract(path, "[^/]*$", 0) != "MEMORY.md")
    if kind == "code_repo":
        keep = keep & ~F.arrays_overlap(F.split(F.regexp_replace(path, "(^|/)[^/]*$", ""), "/"), F.array(*[F.lit(x) for x in SKIP_DIRS]))
    return keep


def read_tree(spark: SparkSession, root: str, kind: str, include: str | None = None, exclude: str | None = None) -> DataFrame:
    """(path, modified, size, content) of a source's files; a root that is one file gives that file."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    clean = re.sub("^[a-z0-9]+:/*", "", root).strip("/")
    relative = F.regexp_replace("path", f"^([a-z0-9]+:)?/*{re.escape(clean)}/?", "")
    single = relative == ""
    named = F.when(single, F.regexp_extract("path", "[^/]*$", 0)).otherwise(relative)
    return files.where(single | wanted(relative, kind, include, exclude)).select(named.alias("path"), F.col("modificationTime").alias("modified"), F.col("length").alias("size"), "content")


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


def language(path: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])[extension(path)]


def header(text: str) -> dict:
    """The lines between the two --- lines at the start as a mapping: scalars, lists in brackets or behind dashes, and mappings by their indent."""
    block = re.match(r"---\r?\n(.*?)\r?\n---[ \t]*(?:\r?\n|\Z)", text, re.DOTALL)
    lines = [x for x in (block[1].splitlines() if block else []) if x.strip() and not x.lstrip().startswith("#")]
    indent = lambda x: len(x) - len(x.lstrip())

    def scalar(x: str):
        x = x.strip()
        if len(x) >= 2 and x[0] == x[-1] and x[0] in "'\"":
            return x[1:-1]
        if x.startswith("[") and x.endswith("]"):
            return [scalar(y) for y in x[1:-1].split(",") if y.strip()]
        low = x.lower()
        if low in ("", "null", "~"):
            return None
        if low in ("true", "false"):
            return low == "true"
        return int(x) if re.fullmatch(r"-?[0-9]{1,18}", x) else x

    def read(at: int, depth: int):
        if at < len(lines) and lines[at].lstrip().startswith("- "):
            out: list = []
            while at < len(lines) and indent(lines[at]) == depth and lines[at].lstrip().startswith("- "):
                out.append(scalar(lines[at].lstrip()[2:]))
                at += 1
            return out, at
        made: dict = {}
        while at < len(lines) and indent(lines[at]) == depth:
            key, found, value = lines[at].strip().partition(":")
            at += 1
            if not found or not re.fullmatch(r"[A-Za-z_][A-Za-z0-9_-]*", key.strip()):
                continue
            below = at < len(lines) and (indent(lines[at]) > depth or (indent(lines[at]) == depth and lines[at].lstrip().startswith("- ")))
            if not value.strip() and below:
                made[key.strip()], at = read(at, indent(lines[at]))
            else:
                made[key.strip()] = scalar(value)
            while at < len(lines) and indent(lines[at]) > depth:  # what is indented below a plain value has no meaning
                at += 1
        return made, at

    made = read(0, indent(lines[0]) if lines else 0)[0]
    return made if isinstance(made, dict) else {}


def frontmatter_json(text: Column) -> Column:
    """A text's header as JSON, `{}` without one; its lists and mappings nest, so it is read in Python, batch by batch."""
    @F.pandas_udf("string")
    def read(parts: pd.Series) -> pd.Series:
        return parts.map(lambda t: json.dumps(header(t), ensure_ascii=False) if t and t.startswith("---") else "{}")

    return read(text)


def said(fm: Column, key: str) -> Column:
    """A scalar of a header as text, null where it is missing."""
    return F.get_json_object(fm, f"$.{key}")


def body_of(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\A---\r?\n.*?\r?\n---[ \t]*(\r?\n|\z)", "")


def plain(text: Column) -> Column:
    """Lines without trailing blanks, blank lines at the end gone."""
    return F.regexp_replace(F.array_join(F.transform(F.split(text, "\n"), lambda x: F.regexp_replace(x, r"[ \t\r\f]+$", "")), "\n"), r"\n+$", "")


def parsed(files: DataFrame, kind: str, project_key: str | None = None) -> DataFrame:
    """Node rows of document files: type, name, description, project, flags and hash by rule; a document that isn't UTF-8 has its bad bytes replaced."""
    f = files.select("path", "content", texts(files).alias("t")).select("path", "content", frontmatter_json(F.col("t")).alias("fm"), body_of(F.col("t")).alias("body"))
    name = F.regexp_replace(F.regexp_extract("path", "[^/]*$", 0), r"\.[^.]*$", "")
    default = {"memory_dir": None, "plan_dir": "plan_doc", "docs_dir": "project_doc", "claude_md": "project_doc"}.get(kind)
    by_name = F.when(name.rlike("^feedback_"), "memory_feedback").when(name.rlike("^user_"), "memory_user").when(name.rlike("^reference_"), "memory_reference").otherwise("memory_project")
    named = F.concat(F.lit("memory_"), F.trim(said(F.col("fm"), "type")))
    folder = F.nullif(F.regexp_extract("path", r"projects[\\/]([^\\/]+)[\\/]memory", 1), F.lit(""))
    heading = F.nullif(F.trim(F.regexp_extract("body", r"(?m)^#+[ \t]+(.+)$", 1)), F.lit(""))
    return f.select(
        F.sha1(F.col("path").cast("binary")).alias("id"),
        F.coalesce(F.when(named.isin(*NODE_TYPES), named), F.when(said(F.col("fm"), "type").isin(*NODE_TYPES), said(F.col("fm"), "type")), F.lit(default) if default else by_name).alias("type"),
        F.coalesce(said(F.col("fm"), "name"), name).alias("name"),
        F.coalesce(F.nullif(F.trim(said(F.col("fm"), "description")), F.lit("")), heading, F.substring(F.trim("body"), 1, 100)).alias("description"),
        "body",
        F.col("path").alias("source_path"),
        F.coalesce(F.lit(project_key), F.nullif(F.trim(said(F.col("fm"), "projectKey")), F.lit("")), folder).alias("project_key"),
        truthy(said(F.col("fm"), "base")).alias("base"),
        F.coalesce(truthy(F.nullif(said(F.col("fm"), "local_only"), F.lit(""))) & said(F.col("fm"), "local_only").isNotNull(), F.lit(False)).alias("_flag"),
        said(F.col("fm"), "local_only").isNotNull().alias("_said"),
        F.sha2("content", 256).alias("hash"),
        F.col("fm").alias("frontmatter_json"),
    ).select("id", "type", "name", "description", "body", "source_path", "project_key", "base", F.when(F.col("_said"), F.col("_flag")).otherwise(F.col("source_path").rlike("(^|/)_private(/|$)") | F.startswith(F.ltrim("body"), F.lit("[LOCAL ONLY]"))).alias("local_only"), "hash", "frontmatter_json")


def preview(files: DataFrame) -> DataFrame:
    """Files by extension, and markdown with a typed header."""
    block = F.regexp_extract(valid_text(F.col("content")), r"\A---\r?\n((?s).*?)\r?\n---[ \t]*(?:\r?\n|\z)", 1)
    typed = (extension(F.col("path")) == "md") & block.rlike(r"(?m)^type[ \t]*:")
    return files.groupBy(extension(F.col("path")).alias("ext")).agg(F.count("*").alias("n"), F.count_if(typed).alias("typed"))


def proposed_kind(md: Column, typed: Column, src: Column, has_git: Column) -> Column:
    return F.when(has_git & (src > 0), "code_repo").when(typed >= 1, "memory_dir").when((md >= 2) & (src == 0), "docs_dir")


def pdf_text(content: Column) -> Column:
    """Pages of PDF files as text under `--- page N ---` lines, by the reader that is installed; without one an error says so."""
    try:
        from pypdf import PdfReader
    except ImportError as e:
        raise RuntimeError("reading PDF needs the package pypdf") from e
    @F.pandas_udf("string")
    def read(parts: pd.Series) -> pd.Series:
        def one(data: bytes | None) -> str | None:
            if data is None:
                return None
            return "\n\n".join(f"--- page {k} ---\n{(p.extract_text() or '').strip()}" for k, p in enumerate(PdfReader(io.BytesIO(data)).pages, 1))

        return parts.map(one)

    return read(content)


def valid_text(content: Column) -> Column:
    return F.make_valid_utf8(content.cast("string"))


#: Extension -> a function from a content column to a text column; others can be added.
PARSERS = {"md": valid_text, "markdown": valid_text, "txt": lambda c: plain(valid_text(c)), "pdf": pdf_text}


def texts(files: DataFrame) -> Column:
    """The text of each file by its extension's reader; an extension without one is an error. Only readers of extensions that occur are asked for."""
    found = sorted(r["e"] for r in files.select(extension(F.col("path")).alias("e")).distinct().collect())  # extensions, not files
    missing = [e for e in found if e not in PARSERS]
    if missing:
        raise ValueError(f"no reader for .{missing[0]}")
    out = F.lit(None).cast("string")
    for e in found:
        out = F.when(extension(F.col("path")) == e, PARSERS[e](F.col("content"))).otherwise(out)
    return out


def changed(fresh: DataFrame, current: DataFrame) -> DataFrame:
    """(source_path, status): added, updated, unchanged or removed by content hash."""
    j = fresh.select("source_path", F.col("hash").alias("_new")).join(current.select("source_path", F.col("hash").alias("_old")), "source_path", "full_outer")
    status = F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "removed").when(F.col("_old") == F.col("_new"), "unchanged").otherwise("updated")
    return j.select("source_path", status.alias("status"))
