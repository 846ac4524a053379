"""Verdicts on files before they are read into the graph, as column expressions.

Contents are bytes (a text column counts as its UTF-8 bytes). As features of the tests, binary share looks at the first 8 KiB,
secrets at the first 32 KiB, marks of generators at the first 512 bytes and entropy at the first 16 KiB; repeated lines are
counted over the whole content.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Limits. Fixed values.
OVERSIZE, NONPRINTABLE, ENTROPY, REPEATED = 5 * 1024 * 1024, 0.30, 7.5, 0.80
#: Marks of generated files, names of lock files, folders and names of build output. Fixed values.
GENERATED = ("@generated", "GENERATED FILE", "AUTOGENERATED", "AUTO-GENERATED", "Code generated by", "DO NOT EDIT", "This file is automatically generated", "This file was automatically generated")
LOCK_FILES = ("package-lock.json", "yarn.lock", "pnpm-lock.yaml", "uv.lock", "poetry.lock", "pipfile.lock", "cargo.lock", "go.sum", "composer.lock", "gemfile.lock", "bun.lockb")
BUILD_DIRS = ("dist", "build", "out", "node_modules", "vendor", "__pycache__", ".next", ".nuxt", ".cache", ".parcel-cache", "target", ".pytest_cache")
BUILD_NAMES = ("bundle.js", "bundle.css", "vendor.js", "vendor.css", "main.js")
#: Kinds of secrets and their patterns. Fixed values.
SECRETS = {
    "private_key": r"-----BEGIN [A-Z ]*PRIVATE KEY-----",
    "aws_access_key": r"\bAKIA[A-Z0-9]{16}\b",
    "jwt_blob": r"\beyJ[A-Za-z0-9_\-]{16,}\.[A-Za-z0-9_\-]{10,}\.[A-Za-z0-9_\-]{10,}\b",
    "github_token": r"\bgh[psoru]_[A-Za-z0-9]{36}\b",
    "bearer_secret": r"(?i)(?:secret|api[_\-]?key|access[_\-]?token|password)\s*[:=]\s*['\"][A-Za-z0-9_\-+/=]{20,}['\"]",
}


def name_of(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, "[^/]*$", 0))


def head(content: Column, size: int) -> Column:
    """The first bytes, as a text with one letter for each."""
    return F.decode(F.substring(content.cast("binary"), 1, size), "ISO-8859-1")


def nonprintable_share(content: Column, sample: int = 8192) -> Column:
    h = head(content, sample)
    return F.when(F.length(h) > 0, (F.length(h) - F.length(F.regexp_replace(h, r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", ""))) / F.length(h)).otherwise(F.lit(0.0))


def secret_kind(path: Column, content: Column) -> Column:
    h = head(content, 32_768)
    out = None
    for kind, pattern in SECRETS.items():
        out = F.when(h.rlike(pattern), kind) if out is None else out.when(h.rlike(pattern), kind)
    env = name_of(path).rlike(r"^\.env$|^env$|^\.env\.|\.env$") & (F.regexp_count(h, F.lit(r"(?m)^\s*[A-Z][A-Z0-9_]+\s*=")) >= 3)
    return out.when(env, "dotenv")


def generated(content: Column) -> Column:
    h = head(content, 512)
    out = F.lit(False)
    for mark in GENERATED:
        out = out | F.contains(h, F.lit(mark))
    return out


def name_reason(path: Column) -> Column:
    n = name_of(path)
    parts = F.transform(F.split(path, "/"), F.lower)
    build = F.get(F.filter(parts, lambda p: p.isin(*BUILD_DIRS)), F.lit(0))
    return (
        F.when(n.isin(*LOCK_FILES), F.concat(F.lit("lock_file:"), n)).when(n.rlike(r"\.lockb?$"), "lock_file").when(n.rlike(r"\.min\.(js|css|mjs|cjs)$"), "minified").when(n.rlike(r"\.snap$"), "snapshot")
        .when(n.rlike(r"\.bundle\.(js|css|mjs)$"), "bundle").when(n.rlike(r"\.map$"), "sourcemap").when(build.isNotNull(), F.concat(F.lit("build_output_dir:"), build)).when(n.isin(*BUILD_NAMES), F.concat(F.lit("build_output:"), n))
    )


def entropy(content: Column, sample: int = 16_384) -> Column:
    """Shannon entropy in bits of the first bytes; sorted runs give the counts without a shuffle."""
    letters = F.sort_array(F.split(head(content, sample), ""))

    def of(c: Column) -> Column:
        n = F.size(c)
        starts = F.filter(F.transform(c, lambda x, k: F.when((k == 0) | (F.get(c, k - 1) != x), k)), lambda k: k.isNotNull())
        return F.transform(F.array(starts), lambda s: -F.aggregate(F.transform(s, lambda a, k: (F.coalesce(F.get(s, k + 1), n) - a) / n), F.lit(0.0), lambda acc, p: acc + p * F.log2(p)))[0]

    return F.transform(F.array(letters), of)[0]


def lines_of(content: Column) -> Column:
    """Lines; a line end at the very end starts no further line."""
    text = F.make_valid_utf8(content.cast("string"))
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(F.regexp_replace(text, r"(\r\n|\n|\r)\z", ""), r"\r\n|\n|\r"))


def repeated_share(content: Column) -> Column:
    """Share of the most frequent line."""

    def of(c: Column) -> Column:
        starts = F.filter(F.transform(c, lambda x, k: F.when((k == 0) | (F.get(c, k - 1) != x), k)), lambda k: k.isNotNull())
        return F.transform(F.array(starts), lambda s: F.array_max(F.transform(s, lambda a, k: F.coalesce(F.get(s, k + 1), F.size(c)) - a)) / F.size(c))[0]

    return F.transform(F.array(F.sort_array(lines_of(content))), of)[0]


def classify(files: DataFrame, extensions: tuple[str, ...], size_limit: int = OVERSIZE) -> DataFrame:
    """files (path, content, size) with verdict (ok, auto_skipped, suspicious) and reason; cheap tests decide first."""
    ext = F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1))
    c = F.col("content")
    told = lambda what, value, limit, strict: F.transform(F.array(value), lambda x: F.when((x > limit) if strict else (x >= limit), F.concat(F.lit(f"{what}:"), F.format_string("%.2f", x.cast("double")))))[0]
    large = (F.col("size") >= 100_000) & (F.size(lines_of(c)) >= 100)
    by_content = F.coalesce(
        told("binary_masquerade", nonprintable_share(c), NONPRINTABLE, True),
        F.concat(F.lit("suspected_secret:"), secret_kind(F.col("path"), c)),
        F.when(generated(c), "autogenerated"),
        F.when(F.octet_length(c) >= 256, told("high_entropy", entropy(c), ENTROPY, True)),
        F.when(large, told("repeated_line_bloat", repeated_share(c), REPEATED, False)),
    )
    reason = (
        F.when(~ext.isin(*extensions), F.concat(F.lit("unsupported_ext:"), F.when(ext == "", "<none>").otherwise(ext)))
        .when(F.col("size") > size_limit, F.concat(F.lit("oversize:"), F.col("size")))
        .otherwise(F.coalesce(name_reason(F.col("path")), by_content))
    )
    made = files.withColumn("reason", reason)
    skipped = F.col("reason").rlike("^(unsupported_ext|oversize):")
    return made.withColumn("verdict", F.when(F.col("reason").isNull(), "ok").when(skipped, "auto_skipped").otherwise("suspicious"))
