"""Rules and gates."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon import views as v
from quillon.catalog import query
from quillon.plans import governance as g

o = v.oracle
_RULES = """SELECT rule FROM VALUES
('{"id":"r1","modality":"MUST","enforcement":"block","applies_to":{"glob":["*/src1/*"]},"requires_step":"verify","verify":{"command":"pytest"}}'),
('{"id":"r2","modality":"MUST_NOT","enforcement":"block","applies_to":{"tool":["delete"],"tool_arg_match":"^9"}}'),
('{"id":"r3","enforcement":"require-ack","applies_to":{"intent":["debug"]},"requires_step":"review"}'),
('{"id":"r4","modality":"SHOULD","base":true}') AS t(rule)"""
_CTX = "SELECT id AS context_id, id % 50 AS session, source_path AS path, CASE WHEN id % 6 = 0 THEN 'delete' ELSE 'read' END AS tool, id::VARCHAR AS arg, id % 4 = 0 AS debug FROM v_nodes"
_BOUND = f"x AS ({_CTX}), b AS (SELECT context_id, session, 'r1' AS rule_id FROM x WHERE contains(path, '/src1/') UNION ALL SELECT context_id, session, 'r2' FROM x WHERE tool = 'delete' AND starts_with(arg, '9') UNION ALL SELECT context_id, session, 'r3' FROM x WHERE debug UNION ALL SELECT context_id, session, 'r4' FROM x)"


def _contexts(s, d):
    n = v.nodes(s, d)
    return n.select(F.col("id").alias("context_id"), (F.col("id") % 50).alias("session"), F.col("source_path").alias("path"), F.when(F.col("id") % 6 == 0, "delete").otherwise("read").alias("tool"), F.col("id").cast("string").alias("arg"), F.when(F.col("id") % 4 == 0, F.array(F.lit("debug"))).otherwise(F.array(F.lit("none"))).alias("tags"))


def _bound(s, d):
    return g.active(_contexts(s, d), g.parse_rules(s.sql(_RULES)))


@query("rule_applicability", o("nodes", f"WITH {_BOUND} SELECT context_id, rule_id FROM b"))
def _(s, d):
    return _bound(s, d).select("context_id", "rule_id")


@query("active_rules", o("nodes", f"WITH {_BOUND} SELECT rule_id, count(*)::BIGINT AS n FROM b GROUP BY rule_id"))
def _(s, d):
    return _bound(s, d).groupBy("rule_id").agg(F.count("*").alias("n"))


@query("rules_by_context", o("nodes", f"WITH {_BOUND} SELECT context_id, rule_id, rank FROM (SELECT context_id, rule_id, row_number() OVER (PARTITION BY context_id ORDER BY CASE rule_id WHEN 'r2' THEN 3 WHEN 'r1' THEN 2 ELSE 1 END DESC, rule_id)::INTEGER AS rank FROM b) WHERE rank <= 2"))
def _(s, d):
    return g.ranked(_bound(s, d), limit=2).select("context_id", "rule_id", "rank")


@query("mandatory_rules_in_scope", o("nodes", f"WITH {_BOUND} SELECT context_id, rule_id FROM b WHERE rule_id IN ('r1', 'r2')"))
def _(s, d):
    return g.active(_contexts(s, d), g.parse_rules(s.sql(_RULES)), ["p1"], mandatory_only=True).select("context_id", "rule_id")


@query("gate_decision", o("nodes", f"WITH {_BOUND}, k AS (SELECT * FROM b WHERE rule_id <> 'r4' AND NOT (rule_id = 'r1' AND session % 2 = 0)), j AS (SELECT context_id, bool_or(rule_id IN ('r1', 'r2')) AS hard, string_agg(rule_id, ',' ORDER BY rule_id) AS rules FROM k GROUP BY context_id) SELECT x.context_id, CASE WHEN hard IS NULL THEN 'allow' WHEN hard THEN 'deny' ELSE 'ask' END AS permission, coalesce(rules, '') AS rules FROM x LEFT JOIN j USING (context_id)"))
def _(s, d):
    done = s.range(0, 50, 2).select(F.col("id").alias("session"), F.lit("r1").alias("rule_id"), F.lit("verify").alias("step"))
    return g.gate(_bound(s, d), done)


@query("modality_order", o("nodes", "WITH r AS (SELECT 'd' || id AS rule_id, CASE id % 5 WHEN 0 THEN 2 WHEN 1 THEN 3 WHEN 2 THEN 1 WHEN 3 THEN 1 ELSE 2 END AS rank FROM v_nodes) SELECT rule_id, rank FROM r ORDER BY rank DESC, rule_id LIMIT 30"))
def _(s, d):
    """A rule in each node's header, some with a modality that is unknown or missing; the 30 strictest."""
    k = F.col("id")
    said = F.when(k % 5 == 1, ',"modality":"MUST_NOT"').when(k % 5 == 2, ',"modality":"SHOULD"').when(k % 5 == 3, ',"modality":"soon"').otherwise(',"modality":"MUST"')
    rules = v.nodes(s, d).select(F.concat(F.lit('{"id":"d'), k, F.lit('"'), said, F.lit("}")).alias("rule"))
    return g.parse_rules(rules).select("rule_id", g.modality_rank().alias("rank")).orderBy(F.desc("rank"), "rule_id").limit(30)


@query("rules_of_nodes", o("nodes", "SELECT 'd' || id AS rule_id, CASE id % 5 WHEN 1 THEN 'MUST_NOT' WHEN 2 THEN 'SHOULD' WHEN 3 THEN 'SHOULD' ELSE 'MUST' END AS modality, CASE WHEN id % 3 = 0 THEN 'block' ELSE 'advise' END AS enforcement, CASE WHEN id % 2 = 0 THEN 'docs/' || id || '/*,*.md' ELSE '' END AS globs, CASE WHEN id % 7 = 0 THEN 'check ' || id END AS verify_command, project_key, id % 4 = 0 AS base FROM v_nodes"))
def _(s, d):
    """Rules parsed from one JSON text for each node, with every field given, missing or wrong in some."""
    k, maybe = F.col("id"), lambda c, x: F.when(c, x).otherwise(F.lit(""))
    text = F.concat(
        F.lit('{"id":"d'), k, F.lit('"'), F.when(k % 5 == 1, ',"modality":"MUST_NOT"').when(k % 5 == 2, "").when(k % 5 == 3, ',"modality":"soon"').otherwise(',"modality":"MUST"'),
        maybe(k % 3 == 0, F.lit(',"enforcement":"block"')), maybe(k % 2 == 0, F.concat(F.lit(',"applies_to":{"glob":["docs/'), k, F.lit('/*","*.md"]}'))), maybe(k % 7 == 0, F.concat(F.lit(',"verify":{"command":"check '), k, F.lit('"}'))),
        maybe(F.col("project_key").isNotNull(), F.concat(F.lit(',"project":"'), F.coalesce("project_key", F.lit("")), F.lit('"'))), maybe(k % 4 == 0, F.lit(',"base":true')), F.lit("}"),
    )
    return g.parse_rules(v.nodes(s, d).select(text.alias("rule"))).select("rule_id", "modality", "enforcement", F.array_join("globs", ",").alias("globs"), "verify_command", "project_key", "base")


@query("verify_commands", o("nodes", "SELECT id, id % 9 IN (0, 2, 3, 6, 8) AS ok FROM v_nodes"))
def _(s, d):
    """One command line for each node, whose check carries its id: wrapped, piped, quoted, squeezed, with another id, or a longer word."""
    k = F.col("id")
    want = F.concat(F.lit("check run"), k)
    forms = [F.concat(F.lit("cd x && uv run check run"), k, F.lit(" .")), F.concat(F.lit('echo "check run'), k, F.lit('"')), F.concat(F.lit("  check    run"), k), F.concat(F.lit("ls; poetry run  check run"), k), F.concat(F.lit("check run"), k, F.lit("er")), F.concat(F.lit("check run"), k + 1),
             F.concat(F.lit("a | npx check run"), k, F.lit(" -q || true")), F.lit(""), F.concat(F.lit("false || check run"), k)]
    run = F.get(F.array(*forms), (k % 9).cast("int"))
    return v.nodes(s, d).select("id", g.satisfies(want, run).alias("ok"))
