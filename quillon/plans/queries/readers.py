"""Queries over readers, inference rules and small writes."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon import views as v
from quillon.catalog import query
from quillon.functions import text as t
from quillon.operators import audit, writes
from quillon.session import table
from quillon.sources import files, gitlog

o = v.oracle


@query("text_reader", o("nodes", r"SELECT id, sha256(regexp_replace(regexp_replace(x, '(?m)[ \t\r\f]+$', '', 'g'), '\n+$', '')) AS body FROM (SELECT id, replace(coalesce(body, ''), '. ', '. ' || chr(9) || chr(10)) || chr(10) || chr(32) || chr(10) AS x FROM v_nodes)"))
def _(s, d):
    """Plain texts with blanks at line ends and blank lines at their end."""
    body = F.concat(F.replace(F.coalesce("body", F.lit("")), F.lit(". "), F.lit(". \t\n")), F.lit("\n \n"))
    return v.nodes(s, d).select("id", F.sha2(files.plain(body).cast("binary"), 256).alias("body"))


_HEADED = "SELECT id, CASE id % 4 WHEN 0 THEN 'said ' || id WHEN 1 THEN 'Title ' || id WHEN 2 THEN 'plain ' || id ELSE 'Deep' END AS description, CASE WHEN id % 3 = 0 THEN 'k' || id WHEN id % 3 = 1 THEN 'p' || (id % 8) END AS project_key, CASE id % 5 WHEN 0 THEN 'memory_user' WHEN 1 THEN 'rule' WHEN 2 THEN 'memory_feedback' ELSE 'memory_project' END AS type, CASE id % 6 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN true ELSE id % 7 = 0 END AS local_only FROM v_nodes"


@query("document_inference", o("nodes", _HEADED))
def _(s, d):
    """Type, description, project and the local flag of documents: from their header, else their path, heading or text."""
    k = F.col("id")
    maybe = lambda c, *x: F.when(c, F.concat(*x)).otherwise(F.lit(""))
    head = F.concat(
        F.lit("---\nname: n"), k, maybe(k % 4 == 0, F.lit("\ndescription: said "), k), maybe(k % 3 == 0, F.lit("\nprojectKey: ' k"), k, F.lit(" '")), maybe(k % 5 == 0, F.lit("\ntype: user")), maybe(k % 5 == 1, F.lit("\ntype: rule")), maybe(k % 5 == 3, F.lit("\ntype: nonsense")),
        maybe(k % 6 == 0, F.lit("\nlocal_only: yes")), maybe(k % 6 == 1, F.lit("\nlocal_only: no")), F.lit("\n---\n"),
    )
    body = F.concat(F.when(k % 6 == 2, "[LOCAL ONLY] ").otherwise(""), F.when(k % 4 == 1, F.concat(F.lit("\n# Title "), k, F.lit("\ntext"))).when(k % 4 == 3, "x\n### Deep \n# Later").otherwise(F.concat(F.lit("plain "), k)))
    path = F.concat(F.when(k % 7 == 0, "_private/").otherwise(""), F.when(k % 3 == 1, F.concat(F.lit("a/projects/p"), k % 8, F.lit("/memory/"))).otherwise("b/"), F.when(k % 5 == 2, "feedback_").otherwise("note_"), k, F.lit(".md"))
    made = files.parsed(v.nodes(s, d).select(path.alias("path"), F.concat(head, body).cast("binary").alias("content")), "memory_dir")
    cut = F.when(F.startswith("description", F.lit("[LOCAL ONLY] ")), F.substring("description", 14, 100)).otherwise(F.col("description"))
    return made.select(F.regexp_extract("name", "[0-9]+", 0).cast("long").alias("id"), cut.alias("description"), "project_key", "type", "local_only")


@query("test_symbols", o("nodes", "SELECT id FROM v_nodes WHERE id % 4 = 0 OR id % 5 = 0 OR id % 7 = 0"))
def _(s, d):
    k = F.col("id")
    name = F.concat(F.when(k % 4 == 0, F.when(k % 8 == 0, "_test_").otherwise("test_")).otherwise("attest_"), k)
    path = F.concat(F.when(k % 5 == 0, "a/Tests/").when(k % 7 == 0, "b\\test\\").otherwise("a/testing/"), k, F.lit(".py"))
    return v.nodes(s, d).where(t.test_symbol(name, path)).select("id")


_LINES = "string_split(coalesce(body, ''), chr(10))"


@query("head_lines", o("nodes", f"SELECT id, sha256(CASE WHEN len({_LINES}) > 2 THEN array_to_string({_LINES}[1:2], chr(10)) || chr(10) || '... (' || (len({_LINES}) - 2) || ' more lines)' ELSE coalesce(body, '') END) AS cut, sha256(regexp_replace(array_to_string({_LINES}[1:2], chr(10)), '\\s+$', '')) AS bare FROM v_nodes"))
def _(s, d):
    """The first two lines with a mark for the rest, and without it again."""
    cut = t.head_lines(F.coalesce("body", F.lit("")), 2)
    bare = F.regexp_replace(t.strip_truncation(cut), r"\s+$", "")
    return v.nodes(s, d).select("id", F.sha2(cut.cast("binary"), 256).alias("cut"), F.sha2(bare.cast("binary"), 256).alias("bare"))


@query("concept_windows", o("nodes", "SELECT id, CASE WHEN instr(body, w) > 0 THEN substr(body, greatest(instr(body, w) - 20, 1), instr(body, w) - greatest(instr(body, w) - 20, 1) + length(w) + 20) ELSE '' END AS around FROM (SELECT id, coalesce(body, '') AS body, substr(coalesce(body, ''), 31, 9) || CASE WHEN id % 9 = 0 THEN '~none~' ELSE '' END AS w FROM v_nodes) WHERE w <> ''"))
def _(s, d):
    """Twenty characters around a piece of each text, some of which are nowhere."""
    n = v.nodes(s, d).select("id", F.coalesce("body", F.lit("")).alias("body"))
    n = n.withColumn("w", F.concat(F.substring("body", 31, 9), F.when(F.col("id") % 9 == 0, "~none~").otherwise(""))).where("w <> ''")
    return n.select("id", t.concept_context(F.col("body"), F.col("w"), 20).alias("around"))


@query("module_paths", o("nodes", "SELECT id, source_path AS module FROM v_nodes"))
def _(s, d):
    k = F.col("id")
    made = F.concat("source_path", F.when(k % 3 == 0, F.concat(F.lit(":"), k, F.lit("-"), k + 9)).when(k % 3 == 1, "::A.b").otherwise(""))
    return v.nodes(s, d).select("id", t.module_path(made).alias("module"))


@query("commit_nodes", "SELECT sha1(o_orderkey::VARCHAR) AS id, substr(sha1(o_orderkey::VARCHAR), 1, 7) || ' ' || substr('Change ' || repeat(o_orderpriority || ' ', 9), 1, 80) AS name, 'Change ' || repeat(o_orderpriority || ' ', 9) AS description, 'p' AS project_key, o_orderkey::BIGINT AS updated_at FROM orders")
def _(s, d):
    """Orders as commits, and their nodes."""
    log = table(s, d, "orders").select(F.sha1(F.col("o_orderkey").cast("string").cast("binary")).alias("sha"), F.concat(F.lit("Change "), F.repeat(F.concat("o_orderpriority", F.lit(" ")), 9)).alias("subject"), F.lit("text").alias("body"), F.col("o_orderkey").cast("long").alias("at"))
    return gitlog.commit_nodes(log, "p").select("id", "name", "description", "project_key", "updated_at")


@query("rekey_nodes", o("nodes", "SELECT id, CASE WHEN id % 4 = 0 THEN 'moved/' || id ELSE source_path END AS source_path, updated_at FROM v_nodes"))
def _(s, d):
    """Paths of some nodes change; what has no node changes nothing."""
    n = v.nodes(s, d).select("id", "source_path", "updated_at")
    moves = n.where("id % 4 = 0").select("id", F.concat(F.lit("moved/"), "id").alias("source_path")).unionByName(n.select((-F.col("id") - 1).alias("id"), F.lit("x").alias("source_path")))
    return writes.rekey(n, moves)


@query("edge_remove", o("code_edges", "SELECT src, dst, relation FROM (SELECT src, dst, 'calls' AS relation FROM v_code_edges UNION ALL SELECT src, dst, 'mentions' FROM v_code_edges) WHERE NOT (src % 3 = 0 AND relation = 'calls')"))
def _(s, d):
    """Edges go by source, target and relation; the same pair under another relation stays."""
    e = v.code_edges(s, d)
    both = e.withColumn("relation", F.lit("calls")).unionByName(e.withColumn("relation", F.lit("mentions")))
    gone = e.where("src % 3 = 0").select(F.col("src").alias("a"), F.col("dst").alias("b"), F.lit("calls").alias("r"))
    return writes.delete(both, gone, {"src": "a", "dst": "b", "relation": "r"})


@query("refactor_proposals", o("nodes", "SELECT fingerprint, severity FROM (SELECT CASE id % 4 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' WHEN 2 THEN 'low' ELSE 'candidate' END AS severity, sha1('stale' || chr(10) || id || chr(10) || 'l' || id) AS fingerprint FROM v_nodes) WHERE severity IN ('high', 'medium') ORDER BY severity, fingerprint LIMIT 50"))
def _(s, d):
    """The first fifty findings that are worth a proposal."""
    k = F.col("id")
    made = v.nodes(s, d).select(F.lit("stale").alias("type"), F.get(F.array(*map(F.lit, ("high", "medium", "low", "candidate"))), (k % 4).cast("int")).alias("severity"), F.array(k.cast("string")).alias("node_ids"), F.concat(F.lit("l"), k).alias("locus"))
    return audit.proposals(audit.fingerprint(made)).select("fingerprint", "severity")


@query("directory_preview", "SELECT 'md' AS ext, count(*) FILTER (page_id % 3 = 0)::BIGINT AS n, count(*) FILTER (page_id % 6 = 0)::BIGINT AS typed, 'memory_dir' AS kind FROM pages UNION ALL SELECT 'py', count(*) FILTER (page_id % 3 = 1)::BIGINT, 0, 'memory_dir' FROM pages UNION ALL SELECT 'txt', count(*) FILTER (page_id % 3 = 2)::BIGINT, 0, 'memory_dir' FROM pages")
def _(s, d):
    """Pages as files by extension, with typed headers counted, and the kind that the folder is proposed as."""
    k = F.col("page_id")
    text = F.concat(F.when(k % 6 == 0, "---\nname: x\ntype: plan_doc\n---\n").when(k % 3 == 0, "---\nname: x\n---\ntype: no\n").otherwise("type: no\n"), F.coalesce("html", F.lit("")))
    seen = files.preview(table(s, d, "pages").select(F.concat(k, F.lit("."), F.get(F.array(*map(F.lit, ("md", "py", "txt"))), (k % 3).cast("int"))).alias("path"), text.cast("binary").alias("content")))
    of = lambda c, e: F.coalesce(F.max(F.when(F.col("ext") == e, F.col(c))), F.lit(0))
    kind = seen.agg(of("n", "md").alias("md"), of("typed", "md").alias("t"), of("n", "py").alias("py")).select(files.proposed_kind(F.col("md"), F.col("t"), F.col("py"), F.lit(False)).alias("kind"))  # one row
    return seen.crossJoin(F.broadcast(kind))


@query("wanted_paths", "SELECT page_id, page_id % 6 IN (0, 1) AND page_id % 10 <> 1 AS document, page_id % 6 IN (2, 5) AND page_id % 10 <> 1 AS code, page_id % 6 IN (1, 2) AND page_id % 4 <> 0 AS chosen FROM pages")
def _(s, d):
    """Which paths a source of documents, one of code and one with its own globs reads."""
    k = F.col("page_id")
    name = F.get(F.array(*map(F.lit, (".md", ".txt", ".py", ".bin", ".log", ".go"))), (k % 6).cast("int"))
    doc = F.when(k % 10 == 1, F.lit("a/MEMORY.md")).otherwise(F.concat(F.lit("a/b/f"), k, name))
    src = F.concat(F.when(k % 10 == 1, "a/node_modules/").otherwise("a/b/"), F.lit("f"), k, name)
    own = F.concat(F.when(k % 4 == 0, "skip/f").otherwise("a/f"), k, name)
    code = files.wanted(src, "code_repo") & ~name.isin(".md")
    return table(s, d, "pages").select("page_id", files.wanted(doc, "memory_dir").alias("document"), code.alias("code"), files.wanted(own, "memory_dir", "**/*.txt, **/*.py", "skip/").alias("chosen"))
