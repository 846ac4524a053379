"""Scalar functions over text, as Spark columns; none needs Python on the executors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BODY_CAP = 32 * 1024
#: Phrases that mark a negating body. Fixed values.
NEGATIONS = ("do not", "don't", "never", "no longer", "deprecated", "removed", "instead of", "forbidden", "disallowed", "must not", "should not", "avoid")
#: Names that look like concepts but are idioms. Fixed values.
CONCEPT_STOP = ("__init__", "__main__", "__name__", "__file__", "__dict__", "__class__", "self_test", "test_test")
#: Intent tag -> words that reveal it. Fixed values.
INTENTS = {
    "debug": r"error|fail|failure|failing|bug|broken|crash|crashed|stack[- ]?trace|exception|traceback|unresolved|debug|why is",
    "feedback-recall": r"prefer|preference|always|never|don'?t|do not|hard rule|reminder|remember|recall|no co-auth|no trailer|no co-?author|user wants|user prefers",
    "project-context": r"this repo|this project|here|in our|our setup|on this|in this codebase",
    "design": r"design|architecture|architect|approach|pattern|how should|how would|best way|propose",
    "reference": r"where is|what is|find|lookup|location of|locate|reference",
}
#: Intent tag -> node type -> priority. Fixed values.
TYPE_PRIORITY = {
    "debug": {"memory_project": 1.0, "memory_feedback": 0.7, "plan_doc": 0.5, "project_doc": 0.5},
    "feedback-recall": {"memory_feedback": 1.0, "memory_user": 0.8, "memory_project": 0.4},
    "project-context": {"memory_project": 1.0, "project_doc": 0.9, "plan_doc": 0.6},
    "design": {"plan_doc": 1.0, "memory_project": 0.7, "project_doc": 0.6, "memory_feedback": 0.4},
    "reference": {"memory_reference": 1.0, "memory_project": 0.5, "project_doc": 0.4},
    "none": {"memory_user": 0.5, "memory_feedback": 0.6, "memory_project": 0.6, "memory_reference": 0.4, "project_doc": 0.5, "plan_doc": 0.4},
}
#: Patterns of names that look like concepts, in order of priority, and the bounds of their length. Fixed values.
CONCEPT_PATTERNS = (
    r"\b[A-Z][A-Za-z0-9]*[a-z][A-Za-z0-9]*\b",
    r"\b[a-z][a-z0-9]+(?:_[a-z0-9]+){2,}\b",
    r"\b[a-z][a-z0-9]+_[a-z0-9_]+\b",
    r"\b[A-Z][A-Z0-9]*(?:_[A-Z0-9]+)+\b",
)
CONCEPT_LENGTH = (6, 60)


def lexical_tokens(text: Column) -> Column:
    """Lower-cased words that start with a letter, three characters or more."""
    found = F.regexp_extract_all(text, F.lit("[a-zA-Z][a-zA-Z0-9-]+"), F.lit(0))
    return F.filter(F.transform(found, F.lower), lambda t: F.length(t) >= 3)


def search_tokens(text: Column) -> Column:
    """Lower-cased runs of letters, digits and underscores of three characters or more, in order with repeats."""
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9_]{3,}"), F.lit(0))


def lexical_score(tokens: Column, haystack: Column) -> Column:
    """Share of tokens that are substrings of a text's first 32 KiB."""
    return lexical_share(tokens, F.lower(F.substring(haystack, 1, BODY_CAP)))


def lexical_share(tokens: Column, low: Column) -> Column:
    """Share of tokens that are substrings of a text in lower case."""
    return F.when(F.size(tokens) > 0, F.aggregate(tokens, F.lit(0), lambda a, t: a + F.when(F.contains(low, t), 1).otherwise(0)) / F.size(tokens)).otherwise(F.lit(0.0))


def exact_name(name: Column, prompt: Column) -> Column:
    return (F.length(name) >= 4) & F.contains(F.lower(prompt), F.lower(name))


def token_estimate(text: Column) -> Column:
    """floor(words * 1.333) + 1."""
    return (F.floor(word_count(text) * F.lit(1.333)) + 1).cast("long")


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^ \t-\r]+"))


def char_estimate(text: Column) -> Column:
    return F.floor(F.length(text) / 4).cast("long")


def intent_tags(prompt: Column) -> Column:
    """Tags whose words stand in the prompt, else ["none"]."""
    tags = F.array_compact(F.array(*[F.when(F.lower(prompt).rlike(rf"\b({p})\b"), F.lit(tag)) for tag, p in INTENTS.items()]))
    return F.when(F.size(tags) == 0, F.array(F.lit("none"))).otherwise(tags)


def type_priority(tags: Column, kind: Column) -> Column:
    """The highest priority that any tag gives to a node type, else 0."""
    scores = [F.when(F.array_contains(tags, tag) & (kind == t), F.lit(w)).otherwise(F.lit(0.0)) for tag, ws in TYPE_PRIORITY.items() for t, w in ws.items()]
    return F.greatest(*scores)


def has_negation(body: Column) -> Column:
    low = F.lower(F.coalesce(body, F.lit("")))
    out = F.lit(False)
    for phrase in NEGATIONS:
        out = out | F.contains(low, F.lit(phrase))
    return out


def is_stale(body: Column) -> Column:
    return F.contains(F.lower(F.coalesce(body, F.lit(""))), F.lit("superseded"))


def citations(text: Column, prefix: str = "ref") -> Column:
    """Ids cited as [prefix:id], distinct in order."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(rf"\[{prefix}:([^\]]+)\]"), F.lit(1)))


def concepts(body: Column) -> Column:
    """Camel case, snake case and constant names of 6 to 60 characters, by kind and then order."""
    take = lambda k: F.regexp_extract_all(body, F.lit(CONCEPT_PATTERNS[k]), F.lit(0))
    capitals = lambda c: F.length(F.regexp_replace(c, "[^A-Z]", ""))
    bars = lambda c: F.length(c) - F.length(F.replace(c, F.lit("_"), F.lit("")))
    camel = F.filter(take(0), lambda c: capitals(c) >= 2)
    long = F.filter(take(2), lambda c: (F.length(c) >= 12) & (bars(c) < 2))
    return F.array_distinct(F.filter(F.concat(camel, take(1), long, take(3)), lambda c: F.length(c).between(*CONCEPT_LENGTH) & ~c.isin(*CONCEPT_STOP)))


def concept_context(body: Column, concept: Column, around: int = 300) -> Column:
    at = F.instr(body, concept)
    start = F.greatest(at - around, F.lit(1))
    return F.when(at > 0, F.substr(body, start, at - start + F.length(concept) + around)).otherwise(F.lit(""))


def strip_truncation(body: Column) -> Column:
    """Without a trailing `... (N more lines)` mark."""
    return F.regexp_replace(body, r"\s*\.\.\. \([0-9]+ more lines\)\s*$", "")


def nonempty_lines(body: Column) -> Column:
    return F.size(F.filter(F.split(F.coalesce(body, F.lit("")), "\n"), lambda x: x.rlike(r"[^ \t-\r]")))


def head_lines(text: Column, n: int = 60) -> Column:
    lines = F.split(text, "\n")
    return F.when(F.size(lines) > n, F.concat(F.array_join(F.slice(lines, 1, n), "\n"), F.lit("\n... ("), (F.size(lines) - n).cast("string"), F.lit(" more lines)"))).otherwise(text)


def line_slice(text: Column, start: int, end: int, most: int = 400) -> Column:
    """Lines start to end, counted from 1, ends included."""
    return F.array_join(F.slice(F.split(text, "\n"), max(1, start), max(0, min(end - max(1, start) + 1, most))), "\n")


def project_key(path: Column) -> Column:
    """Separators and colons become dashes; dashes at both ends go; runs stay."""
    return F.regexp_replace(F.translate(path, ":/\\", "---"), "^-+|-+$", "")


def owns(source: Column, node_path: Column, exact: Column) -> Column:
    """node_path is the source itself, or, unless exact, stands below it."""
    clean = lambda p: F.regexp_replace(F.replace(p, F.lit("\\"), F.lit("/")), "/+$", "")
    return (clean(node_path) == clean(source)) | (~exact & F.startswith(clean(node_path), F.concat(clean(source), F.lit("/"))))


def ancestors(path: Column) -> Column:
    """All path prefixes at separators, the path itself included; turns ownership into an equality."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))


def module_path(source_path: Column) -> Column:
    return F.regexp_replace(F.split_part(source_path, F.lit("::"), F.lit(1)), r":[0-9]+-[0-9]+$", "")


def line_range(source_path: Column, frontmatter: Column) -> Column:
    """struct(a, b) from JSON, else from a legacy `:a-b` suffix, else null."""
    a = F.coalesce(F.get_json_object(frontmatter, "$.code_unit.line_start"), F.nullif(F.regexp_extract(source_path, r":([0-9]+)-[0-9]+$", 1), F.lit("")))
    b = F.coalesce(F.get_json_object(frontmatter, "$.code_unit.line_end"), F.nullif(F.regexp_extract(source_path, r":[0-9]+-([0-9]+)$", 1), F.lit("")))
    return F.when(a.isNotNull() & b.isNotNull(), F.struct(a.cast("long").alias("a"), b.cast("long").alias("b")))


def trailers(body: Column) -> Column:
    """Targets of Fixes:, Closes: and Refs: lines, distinct in order."""
    found = F.regexp_extract_all(body, F.lit(r"(?im)^[ \t]*(?:fixes|closes|refs):[ \t]*(.+)$"), F.lit(1))
    return F.array_distinct(F.filter(F.transform(F.flatten(F.transform(found, lambda x: F.split(x, ","))), lambda x: F.trim(x)), lambda t: t != ""))


def compact_count(n: Column) -> Column:
    """17919 -> 17.9k."""
    short = lambda x, unit: F.concat(F.regexp_replace((F.floor(x * 10) / 10).cast("decimal(18,1)").cast("string"), r"\.0$", ""), F.lit(unit))
    return F.when(n >= 1_000_000, short(n / 1_000_000, "M")).when(n >= 1000, short(n / 1000, "k")).otherwise(n.cast("string"))


def description_line(prefix: str, node_id: Column, kind: Column, text: Column) -> Column:
    return F.concat(F.lit(f"[{prefix}:"), node_id.cast("string"), F.lit("] ["), kind, F.lit("] "), text)


def private_symbol(name: Column) -> Column:
    """Starts with an underscore and is no dunder name."""
    n = F.coalesce(name, F.lit(""))
    return F.startswith(n, F.lit("_")) & ~(F.startswith(n, F.lit("__")) & F.endswith(n, F.lit("__")))


def test_symbol(name: Column, path: Column) -> Column:
    """Named as a test, or in a folder of tests."""
    place = F.lower(F.replace(F.coalesce(path, F.lit("")), F.lit("\\"), F.lit("/")))
    return F.coalesce(name, F.lit("")).rlike("^_?test_") | F.contains(place, F.lit("/tests/")) | F.contains(place, F.lit("/test/"))


def node_id_shape(x: Column) -> Column:
    return x.rlike("^[0-9a-f]{32}$")


def salted_hash(salt: Column, key: Column) -> Column:
    return F.sha2(F.concat(salt, key).cast("binary"), 256)


def truthy(x: Column) -> Column:
    return F.lower(F.trim(F.coalesce(x, F.lit("")))).isin("true", "yes", "1", "y", "on")


def glob_regex(pattern: str) -> str:
    """A shell pattern as an anchored regular expression."""
    out = "".join(".*" if c == "*" else "." if c == "?" else ("\\" + c if c in ".+^$(){}|\\[]" else c) for c in pattern)
    return f"^{out}$"


def ignore_regex(line: str) -> tuple[str, bool] | None:
    """(regular expression over relative paths, whether it takes paths in) of a line of an ignore file; null for blank and comment lines.

    A slash inside anchors the pattern, `*` and `?` stay inside a name, `**` spans names, a slash at the end means folders only;
    what stands below a matching folder matches.
    """
    pattern = line.rstrip("\n")
    if not pattern.endswith("\\ "):
        pattern = pattern.rstrip()
    if not pattern or pattern.startswith("#"):
        return None
    takes = not pattern.startswith("!")
    pattern = pattern.removeprefix("!")
    folder = pattern.endswith("/")
    pattern = pattern.rstrip("/")
    anchored = "/" in pattern
    pattern = pattern.lstrip("/")
    out, k = "", 0
    while k < len(pattern):
        c = pattern[k]
        if pattern.startswith("**/", k) and (k == 0 or pattern[k - 1] == "/"):
            out, k = out + "(?:.*/)?", k + 3
        elif pattern.startswith("/**", k) and k + 3 == len(pattern):
            out, k = out + "/.+", k + 3
        elif c == "*":
            out, k = out + "[^/]*", k + 1 + pattern.startswith("**", k)
        elif c == "?":
            out, k = out + "[^/]", k + 1
        elif c == "[" and "]" in pattern[k + 2 :]:
            end = pattern.index("]", k + 2)
            inner = pattern[k + 1 : end]
            out, k = out + "[" + ("^" + inner[1:] if inner[0] == "!" else inner).replace("\\", "\\\\") + "]", end + 1
        else:
            k += c == "\\" and k + 1 < len(pattern)
            out, k = out + ("\\" + pattern[k] if pattern[k] in ".+^$(){}|\\[]*?" else pattern[k]), k + 1
    return f"^{'' if anchored else '(?:.*/)?'}{out}{'/.*' if folder else '(?:/.*)?'}$", takes


def ignored(path: Column, lines: list[str]) -> Column:
    """Whether the lines of an ignore file take a relative path in; the last that matches decides."""
    out = F.lit(False)
    for regex, takes in filter(None, map(ignore_regex, lines)):
        out = F.when(path.rlike(regex), F.lit(takes)).otherwise(out)
    return out


def glob_match(pattern: str, path: Column) -> Column:
    p = F.replace(path, F.lit("\\"), F.lit("/"))
    regex = glob_regex(pattern.replace("\\", "/"))
    return p.rlike(regex) | F.regexp_extract(p, "[^/]*$", 0).rlike(regex)
