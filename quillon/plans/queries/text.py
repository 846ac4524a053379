"""Scalar functions over texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon import views as v
from quillon.catalog import query
from quillon.functions import text as t
from quillon.session import table

o = v.oracle
_W = "(^|[^A-Za-z0-9_])({0})($|[^A-Za-z0-9_])"


def _intent_sql(column: str) -> str:
    cases = ", ".join(f"CASE WHEN regexp_matches(lower({column}), '{_W.format(p.replace(chr(39), chr(39) * 2))}') THEN '{k}' END" for k, p in t.INTENTS.items())
    return f"list_filter([{cases}], lambda x: x IS NOT NULL)"


@query("lexical_tokens", o("nodes", "SELECT id, len(w)::BIGINT AS n, array_to_string(list_sort(list_distinct(w)), ' ') AS tokens FROM (SELECT id, list_filter(list_transform(regexp_extract_all(body, '[a-zA-Z][a-zA-Z0-9-]+'), lambda x: lower(x)), lambda x: length(x) >= 3) AS w FROM v_nodes)"))
def _(s, d):
    n = v.nodes(s, d).select("id", t.lexical_tokens(F.col("body")).alias("w"))
    return n.select("id", F.size("w").cast("long").alias("n"), F.array_join(F.array_sort(F.array_distinct("w")), " ").alias("tokens"))


@query("token_estimates", o("nodes", "SELECT id, (floor(len(list_filter(regexp_split_to_array(body, '[ \\t-\\r]+'), lambda x: x <> '')) * 1.333) + 1)::BIGINT AS words_based, (length(body) // 4)::BIGINT AS chars_based FROM v_nodes"))
def _(s, d):
    return v.nodes(s, d).select("id", t.token_estimate(F.col("body")).alias("words_based"), t.char_estimate(F.col("body")).alias("chars_based"))


@query("intent_tags", o("messages", f"SELECT conv_id, seq, CASE WHEN len(tags) = 0 THEN 'none' ELSE array_to_string(tags, ',') END AS tags FROM (SELECT conv_id, seq, {_intent_sql('content')} AS tags FROM v_messages)"))
def _(s, d):
    return v.messages(s, d).select("conv_id", "seq", F.array_join(t.intent_tags(F.col("content")), ",").alias("tags"))


@query("type_priority", o("nodes", f"SELECT id, type, CASE WHEN len(tags) = 0 THEN CASE type WHEN 'memory_project' THEN 0.6::DOUBLE WHEN 'memory_feedback' THEN 0.6::DOUBLE WHEN 'project_doc' THEN 0.5::DOUBLE ELSE 0.4::DOUBLE END ELSE greatest(" + ", ".join(f"CASE WHEN list_contains(tags, '{k}') AND type = '{n}' THEN {w}::DOUBLE ELSE 0::DOUBLE END" for k, ws in t.TYPE_PRIORITY.items() if k != "none" for n, w in ws.items()) + f") END AS priority FROM (SELECT id, type, {_intent_sql('body')} AS tags FROM v_nodes)"))
def _(s, d):
    return v.nodes(s, d).select("id", "type", t.type_priority(t.intent_tags(F.col("body")), F.col("type")).alias("priority"))


@query("description_lines", o("nodes", "SELECT id, '[ref:' || id || '] [' || type || '] ' || name AS line FROM v_nodes"))
def _(s, d):
    return v.nodes(s, d).select("id", t.description_line("ref", F.col("id"), F.col("type"), F.col("name")).alias("line"))


@query("negation_flags", o("nodes", "SELECT id, " + " OR ".join(f"contains(lower(body), '{p.replace(chr(39), chr(39) * 2)}')" for p in t.NEGATIONS) + " AS negates FROM v_nodes"))
def _(s, d):
    return v.nodes(s, d).select("id", t.has_negation(F.col("body")).alias("negates"))


@query("project_key_of_path", o("files", "SELECT path, regexp_replace(translate(path, ':/\\', '---'), '^-+|-+$', '', 'g') AS key FROM v_files"))
def _(s, d):
    return v.files(s, d).select("path", t.project_key(F.col("path")).alias("key"))


@query("nonempty_lines", o("nodes", "SELECT id, len(list_filter(string_split(body, chr(10)), lambda x: regexp_matches(x, '[^ \\t-\\r]')))::BIGINT AS n FROM v_nodes"))
def _(s, d):
    return v.nodes(s, d).select("id", t.nonempty_lines(F.col("body")).cast("long").alias("n"))


@query("code_line_slice", o("nodes", "SELECT id, array_to_string(string_split(body, chr(10))[2:4], chr(10)) AS lines FROM v_nodes"))
def _(s, d):
    return v.nodes(s, d).select("id", t.line_slice(F.col("body"), 2, 4).alias("lines"))


@query("concepts", o("files", r"SELECT page_id, array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all(path, '[a-z][a-z0-9]+(?:_[a-z0-9]+){2,}'), lambda x: length(x) BETWEEN 6 AND 60))), ',') AS concepts FROM (SELECT page_id, 'snake_' || replace(path, '.', '_') || ' plain' AS path FROM v_files)"))
def _(s, d):
    x = v.files(s, d).select("page_id", F.concat(F.lit("snake_"), F.replace("path", F.lit("."), F.lit("_")), F.lit(" plain")).alias("p"))
    return x.select("page_id", F.array_join(F.array_sort(F.filter(t.concepts(F.col("p")), lambda c: c.rlike("^[a-z][a-z0-9]+(_[a-z0-9]+){2,}$"))), ",").alias("concepts"))


@query("citations", o("nodes", "SELECT id, 'ref' || (id % 7) || ',ref' || (id % 3) AS cited FROM v_nodes WHERE id % 7 <> id % 3 UNION ALL SELECT id, 'ref' || (id % 7) FROM v_nodes WHERE id % 7 = id % 3"))
def _(s, d):
    x = v.nodes(s, d).select("id", F.concat(F.lit("see [ref:ref"), F.col("id") % 7, F.lit("] and [ref:ref"), F.col("id") % 3, F.lit("] [other:x]")).alias("text"))
    return x.select("id", F.array_join(t.citations(F.col("text")), ",").alias("cited"))


@query("compact_counts", "SELECT o_orderkey AS k, CASE WHEN n >= 1000000 THEN replace((floor(n / 100000) / 10)::DECIMAL(18,1)::VARCHAR, '.0', '') || 'M' WHEN n >= 1000 THEN replace((floor(n / 100) / 10)::DECIMAL(18,1)::VARCHAR, '.0', '') || 'k' ELSE n::VARCHAR END AS short FROM (SELECT o_orderkey, floor(o_totalprice)::BIGINT AS n FROM orders)")
def _(s, d):
    x = table(s, d, "orders").select(F.col("o_orderkey").alias("k"), F.floor("o_totalprice").cast("long").alias("n"))
    return x.select("k", t.compact_count(F.col("n")).alias("short"))


@query("glob_search", o("nodes", "SELECT id, name FROM v_nodes WHERE regexp_matches(name, '^node_1.5.*$')"))
def _(s, d):
    return v.nodes(s, d).where(t.glob_match("node_1?5*", F.col("name"))).select("id", "name")


@query("line_ranges", o("spans", "SELECT DISTINCT file, symbol, a, b FROM v_spans"))
def _(s, d):
    p = v.spans(s, d).select("file", "symbol", F.concat(F.lit("f"), "file", F.lit(":"), "a", F.lit("-"), "b").alias("p"), F.when(F.col("a") % 20 == 0, F.to_json(F.struct(F.struct(F.col("a").alias("line_start"), F.col("b").alias("line_end")).alias("code_unit")))).alias("fm"))
    return p.select("file", "symbol", t.line_range(F.col("p"), F.col("fm")).alias("r")).select("file", "symbol", "r.a", "r.b").distinct()


@query("commit_trailers", o("nodes", "SELECT id, 'node_' || (id % 5) || ',node_' || (id % 5 + 1) AS targets FROM v_nodes"))
def _(s, d):
    x = v.nodes(s, d).select("id", F.concat(F.lit("subject\n\nFixes: node_"), F.col("id") % 5, F.lit(", node_"), F.col("id") % 5 + 1, F.lit("\nrefs: node_"), F.col("id") % 5).alias("body"))
    return x.select("id", F.array_join(t.trailers(F.col("body")), ",").alias("targets"))
