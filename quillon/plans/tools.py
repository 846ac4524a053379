"""Composite reads over the tables: what a client's tools and pages ask for, each as one plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillon.functions.text import citations
from quillon.operators import graph, joins
from quillon.schema import SEVERITY_RANK


def node_json(nodes: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, json) of wanted nodes."""
    return nodes.join(ids.select("id").distinct(), "id", "left_semi").select("id", F.to_json(F.struct(*[c for c in nodes.columns])).alias("json"))


def edges_of(edges: DataFrame, ids: DataFrame, direction: str = "both", relation: str | None = None) -> DataFrame:
    """(id, direction, other, relation) of the edges (src, dst, relation) at each node of ids; a loop shows on both sides."""
    if direction not in ("in", "out", "both"):
        raise ValueError(f"direction {direction!r}")
    e = edges if relation is None else edges.where(F.col("relation") == relation)
    side = lambda at, to, said: e.join(ids.select(F.col("id").alias(at)).distinct(), at).select(F.col(at).alias("id"), F.lit(said).alias("direction"), F.col(to).alias("other"), "relation")
    out, into = side("src", "dst", "out"), side("dst", "src", "in")
    return out if direction == "out" else into if direction == "in" else out.unionByName(into)


def page_of(total: int, page: int, size: int) -> dict[str, int | bool]:
    """A page within bounds: the first where it is too low, the last where it is too high."""
    last = max(1, -(-total // max(1, size)))
    at = min(max(1, page), last)
    return {"page": at, "pages": last, "offset": (at - 1) * size, "limit": size, "has_next": at < last}


def severity_rank() -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for kv in SEVERITY_RANK.items() for x in kv])[F.col("severity")], F.lit(4))


def queue_page(queue: DataFrame, status: str = "open", limit: int = 50, offset: int = 0) -> DataFrame:
    """A page of findings, the gravest and then the latest first, each with the total of its status and the counts of all."""
    counts = queue.agg(*[F.count_if(F.col("status") == s).alias(f"n_{s}") for s in ("open", "dismissed", "resolved")])  # one row
    order = (severity_rank(), F.desc("last_seen"), "fingerprint")
    return queue.where(F.col("status") == status).orderBy(*order).offset(offset).limit(limit).crossJoin(F.broadcast(counts))


def session_nodes(messages: DataFrame, edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(conv_id, id, role): nodes that a conversation cites in its texts or names as arguments, and their neighbours."""
    cited = F.concat(citations(F.coalesce("content", F.lit(""))), F.coalesce(F.regexp_extract_all("content", F.lit(r'"node_id"\s*:\s*"?([A-Za-z0-9]+)'), F.lit(1)), F.array().cast("array<string>")))
    own = messages.select("conv_id", F.explode(cited).alias("id")).distinct().join(nodes.select(F.col("id").cast("string").alias("id")), "id", "left_semi")
    e = edges.select(F.col("src").cast("string").alias("src"), F.col("dst").cast("string").alias("dst"))
    both = e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    near = own.join(both, F.col("id") == F.col("src")).select("conv_id", F.col("dst").alias("id")).distinct().join(own, ["conv_id", "id"], "left_anti").join(nodes.select(F.col("id").cast("string").alias("id")), "id", "left_semi")
    return own.select("conv_id", "id", F.lit("cited").alias("role")).unionByName(near.select("conv_id", "id", F.lit("neighbour").alias("role")))


def effective_scope(requests: DataFrame, sources: DataFrame, nodes: DataFrame, workspaces: DataFrame, state: DataFrame, active: DataFrame) -> DataFrame:
    """(request, project_keys): what each request (request, project_key, active_project, cwd) is scoped to.

    The first that there is of: the key it gives, the older field, its folder's keys, the active workspace's first key, the active project.
    """
    from quillon.operators.store import scope_of

    by_folder = scope_of(requests.select(F.col("request").alias("caller"), "cwd"), sources, nodes).groupBy("caller").agg(F.sort_array(F.collect_set("project_key")).alias("_keys"))
    held = state.limit(1).join(workspaces.select(F.col("id").alias("active_id"), F.get("project_keys", F.lit(0)).alias("_ws")), "active_id", "left").agg(F.max("_ws").alias("_ws"))
    kept = active.limit(1).agg(F.max("project_key").alias("_active"))
    j = requests.join(by_folder, F.col("request") == F.col("caller"), "left").crossJoin(F.broadcast(held)).crossJoin(F.broadcast(kept))  # one row each
    one = lambda c: F.when(F.nullif(F.col(c), F.lit("")).isNotNull(), F.array(c))
    return j.select("request", F.coalesce(one("project_key"), one("active_project"), F.col("_keys"), one("_ws"), one("_active")).alias("project_keys"))


def graph_data(nodes: DataFrame, edges: DataFrame, scope: Column | None = None, limit_types: tuple[str, ...] | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of a scope; nodes without a project that an edge ties to the scope belong to it, and edges need both ends."""
    n = nodes if limit_types is None else nodes.where(F.col("type").isin(*limit_types))
    if scope is not None:
        inside = n.where(scope)
        both = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        tied = both.join(inside.select(F.col("id").alias("dst")), "dst", "left_semi").select(F.col("src").alias("id")).distinct()
        edge_of = n.where("project_key IS NULL").join(tied, "id", "left_semi")
        n = inside.unionByName(edge_of).dropDuplicates(["id"])
    e = edges.join(n.select(F.col("id").alias("src")), "src", "left_semi").join(n.select(F.col("id").alias("dst")), "dst", "left_semi")
    return n, e


def sitemap(routes: DataFrame, components: DataFrame, handlers: DataFrame) -> DataFrame:
    """Endpoints with both sides, by path and method."""
    e = joins.endpoints(routes, components, handlers)
    parts = F.split("endpoint", ":", 3)
    return e.withColumns({"method": parts[1], "path": parts[2]}).orderBy("path", "method")


def project_modules(defines: DataFrame, modules: DataFrame) -> DataFrame:
    """(project_key, module, declarations, n) of modules (id, name, project_key) with what they define (src, dst, name), by project and name."""
    d = defines.groupBy(F.col("src").alias("id")).agg(F.sort_array(F.collect_set("name")).alias("declarations"), F.count("*").alias("n"))
    return modules.join(d, "id", "left").select("project_key", F.col("name").alias("module"), F.coalesce("declarations", F.array().cast("array<string>")).alias("declarations"), F.coalesce("n", F.lit(0)).alias("n")).orderBy("project_key", "module")


def dashboard(nodes: DataFrame, edges: DataFrame, log: DataFrame, feedback: DataFrame, top: int = 6) -> DataFrame:
    """(what, key, n): counts by type, the nodes of highest degree, and the return of the log."""
    by_type = nodes.groupBy(F.col("type").alias("key")).agg(F.count("*").alias("n")).select(F.lit("type").alias("what"), "key", "n")
    degree = graph.degree(edges).orderBy(F.desc("degree"), "id").limit(top).select(F.lit("degree").alias("what"), F.col("id").cast("string").alias("key"), F.col("degree").alias("n"))
    counted = lambda df, key: df.agg(F.count("*").alias("n")).select(F.lit("total").alias("what"), F.lit(key).alias("key"), "n")
    up = feedback.agg(F.count_if(F.col("reason") == "thumbs_up").alias("n")).select(F.lit("total").alias("what"), F.lit("thumbs_up").alias("key"), "n")
    return by_type.unionByName(degree).unionByName(counted(edges, "edges")).unionByName(counted(log, "queries")).unionByName(up)


def suggestions(paths: DataFrame, prefixes: DataFrame, most: int = 50) -> DataFrame:
    """(prefix, path): the first `most` folders or files that go on from a typed prefix, a top-k report. Paths are their own prefixes up to the next slash."""
    from quillon.functions.text import ancestors

    every = paths.select(F.explode(ancestors(F.col("path"))).alias("path")).where("path <> ''").distinct()
    folder = F.regexp_replace(F.col("path"), "[^/]*$", "")
    asked = prefixes.select("prefix", F.regexp_replace("prefix", "[^/]*$", "").alias("folder"))
    met = every.withColumn("folder", folder).join(asked, "folder").where(F.startswith(F.lower("path"), F.lower("prefix")))
    w = Window.partitionBy("prefix").orderBy("path")
    return met.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= most).select("prefix", "path")


def full_source(nodes: DataFrame, files: DataFrame) -> DataFrame:
    """(id, text): the whole file that a node stands in, null where it is not there."""
    own = F.regexp_replace(F.split_part("source_path", F.lit("::"), F.lit(1)), r":[0-9]+-[0-9]+$", "")
    return nodes.select("id", own.alias("path")).join(files.select("path", "text"), "path", "left").select("id", "text")


def repo_key(source_path: Column, root: str = "src") -> Column:
    """A key that is the same on every machine: from the source root on, a commit's short hash after `@`, else the file's name without `.md`."""
    p = F.replace(F.coalesce(source_path, F.lit("")), F.lit("\\"), F.lit("/"))
    inside = F.regexp_extract(p, f"/({root}/.*)$", 1)
    commit = F.substring(F.regexp_extract(p, "@([^@]*)$", 1), 1, 13)
    return F.when(inside != "", inside).when(F.contains(p, F.lit("@")) & ~F.contains(p, F.lit("::")), commit).otherwise(F.regexp_replace(F.regexp_extract(p, "[^/]*$", 0), r"\.md$", ""))


def plain_path(path: Column) -> Column:
    """Slashes one way, a line range at the end gone, lower case."""
    return F.lower(F.regexp_replace(F.replace(F.coalesce(path, F.lit("")), F.lit("\\"), F.lit("/")), r":[0-9]+-[0-9]+$", ""))


def solved(tasks: DataFrame, nodes: DataFrame, edges: DataFrame, recalled: DataFrame | None = None) -> DataFrame:
    """(task, key, calls): the answers that the graph itself gives, one call each.

    tasks: (task, cls, subject); structural: the subject's callers; provenance: the commits that touch it and what moved or closed them;
    memory_recall: recalled (task, id), ranked by a retriever.
    """
    named = nodes.select("id", repo_key(F.col("source_path")).alias("key"))
    e = edges.select("src", "dst", "relation")
    own = lambda cls: tasks.where(F.col("cls") == cls)
    callers = own("structural").join(e.where("relation = 'calls'"), F.col("subject") == F.col("dst")).select("task", F.col("src").alias("id"))
    commits = own("provenance").join(e.where("relation = 'references_function'"), F.col("subject") == F.col("dst")).select("task", F.col("src").alias("commit"))
    moved = commits.join(e.where("relation = 'motivated_by'"), F.col("commit") == F.col("src")).select("task", "commit", F.col("dst").alias("id"))
    closed = commits.join(e.where("relation = 'closed_by'"), F.col("commit") == F.col("dst")).select("task", "commit", F.col("src").alias("id"))
    why = moved.unionByName(closed)
    found = callers.unionByName(why.select("task", "id")).unionByName(why.select("task", F.col("commit").alias("id")))
    if recalled is not None:
        found = found.unionByName(own("memory_recall").join(recalled, "task").select("task", "id"))
    return found.distinct().join(named, "id").select("task", "key", F.lit(1).alias("calls")).distinct()


def resolved_keys(keys: DataFrame, nodes: DataFrame) -> DataFrame:
    """(key, id): the node whose path ends with a key at a separator, the shortest path first; an equality with one of the path's endings."""
    p = nodes.select("id", "source_path", F.split(plain_path(F.col("source_path")), "/").alias("parts"))
    ends = p.select("id", "source_path", F.explode(F.transform(F.sequence(F.lit(1), F.size("parts")), lambda n: F.array_join(F.slice("parts", n, F.size("parts")), "/"))).alias("_end"))
    return keys.select("key", plain_path(F.col("key")).alias("_end")).where("_end <> ''").join(ends, "_end").groupBy("key").agg(F.min_by("id", F.struct(F.length("source_path"), F.col("id"))).alias("id"))


def is_loopback(host: Column) -> Column:
    """Requests of the machine itself need no key."""
    return F.lower(F.coalesce(host, F.lit(""))).isin("127.0.0.1", "::1", "localhost")
