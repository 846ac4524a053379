"""Writes and lookups of the single tables: each write returns the table's new rows and can be repeated without harm."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions.text import ancestors, node_id_shape, salted_hash
from quillon.operators import writes
from quillon.schema import DECISIONS, EDGE_RELATIONS, SIGNALS, STATUSES


def checked(df: DataFrame, column: str, allowed) -> DataFrame:
    """df, or an error where a value stands outside an enumeration."""
    wrong = df.where(F.col(column).isNull() | ~F.col(column).isin(*allowed)).select(column).limit(1).collect()
    if wrong:
        raise ValueError(f"{column} {wrong[0][0]!r} is none of {sorted(allowed)}")
    return df


def _default(df: DataFrame, **values: Column) -> DataFrame:
    return df.withColumns({k: F.coalesce(F.col(k), v) if k in df.columns else v for k, v in values.items()})


# Edges.


def upsert_edges(edges: DataFrame, fresh: DataFrame, now: int) -> DataFrame:
    """Edges with fresh ones in place of those with the same ends and relation; a known relation is asked for, weight and confidence
    are 1 unless given, and the first time of an edge stays."""
    made = _default(checked(fresh, "relation", EDGE_RELATIONS), weight=F.lit(1.0), confidence=F.lit(1.0), source=F.lit("manual"), created_at=F.lit(now).cast("long"))
    return writes.upsert(edges, made.select(edges.columns), ("src_id", "dst_id", "relation"), keep=("created_at",))


def add_co_occurrence(edges: DataFrame, counted: DataFrame, now: int, cap: float = 5.0) -> DataFrame:
    """Edges after the weights of pairs that were retrieved together (src, dst, weight) are added, to `cap` at most.

    Both sides are keyed, so one join does what an upsert does: weight, source and confidence are new, the first time of an edge stays.
    """
    key = ["src_id", "dst_id", "relation"]
    pairs = counted.select(F.col("src").alias("src_id"), F.col("dst").alias("dst_id"), F.lit("co_occurs_with").alias("relation"), F.col("weight").alias("_add"))
    held = edges.withColumn("_held", F.lit(True))
    fresh = {"weight": F.least(F.lit(cap), F.coalesce("weight", F.lit(0.0)) + F.col("_add")), "source": F.lit("co_occurrence"), "confidence": F.lit(1.0)}
    made = {c: F.when(F.col("_add").isNotNull(), x).otherwise(F.col(c)) for c, x in fresh.items()} | {"created_at": F.when(F.col("_held"), F.col("created_at")).otherwise(F.lit(now).cast("long"))}
    return held.join(pairs, key, "full_outer").withColumns({c: x for c, x in made.items() if c in edges.columns}).select(edges.columns)


def declared_edges(nodes: DataFrame, fields: dict[str, str] | None = None) -> DataFrame:
    """(src_id, dst_id, relation) that headers declare: lists under appliesTo, supersedes and derivedFrom of ids or names.

    An id is tried before the first node of a name; targets that nothing has, and the node itself, are left out.
    """
    fields = fields or {"appliesTo": "applies_to", "supersedes": "supersedes", "derivedFrom": "derived_from"}
    lists = F.from_json("frontmatter_json", "struct<" + ",".join(f"{k}:array<string>" for k in fields) + ">")
    named = nodes.where("frontmatter_json IS NOT NULL").select(F.col("id").alias("src_id"), lists.alias("f"))

    def targets(key: str, relation: str) -> Column:
        return F.transform(F.coalesce(F.col(f"f.{key}"), F.array().cast("array<string>")), lambda t: F.struct(F.trim(t).alias("target"), F.lit(relation).alias("relation")))

    each = F.concat(*[targets(k, r) for k, r in fields.items()])
    asked = named.select("src_id", F.explode(each).alias("t")).select("src_id", "t.target", "t.relation").where("target <> ''")
    by_id = nodes.select(F.col("id").cast("string").alias("target"), F.col("id").alias("_a"))
    by_name = nodes.groupBy(F.col("name").alias("target")).agg(F.min("id").alias("_b"))
    found = asked.join(by_id, "target", "left").join(by_name, "target", "left").withColumn("dst_id", F.coalesce("_a", "_b"))
    return found.where("dst_id IS NOT NULL AND dst_id <> src_id").select("src_id", "dst_id", "relation").distinct()


# Sources.


def register_sources(sources: DataFrame, fresh: DataFrame) -> DataFrame:
    """Sources with fresh ones by path; when a source was last read stays known, and a new one is enabled unless it says otherwise."""
    made = _default(fresh, enabled=F.lit(True), include=F.lit(None).cast("string"), exclude=F.lit(None).cast("string"), project_key=F.lit(None).cast("string"), last_indexed_at=F.lit(None).cast("long"))
    return writes.upsert(sources, made.select(sources.columns), ("path",), keep=("last_indexed_at",))


def patch_sources(sources: DataFrame, patches: DataFrame) -> DataFrame:
    """Sources with some columns changed: patches (path, fields array, values); a column that is not among fields stays, one that is can become null."""
    p = patches.select(F.col("path"), F.col("fields").alias("_f"), *[F.col(c).alias(f"_{c}") for c in patches.columns if c not in ("path", "fields")])
    j = sources.join(p, "path", "left")
    return j.select(*[F.when(F.array_contains("_f", c), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) if c != "path" and c in patches.columns else F.col(c) for c in sources.columns])


def remove_sources(tables: dict[str, DataFrame], paths: DataFrame) -> dict[str, DataFrame]:
    """The tables without some sources (path) and, by cascade, without the nodes that stand under them."""
    gone = tables["nodes"].select("id", F.explode(ancestors(F.col("source_path"))).alias("path")).join(paths.select("path").distinct(), "path").select("id").distinct()
    out = writes.delete_nodes(tables, gone)
    out["sources"] = tables["sources"].join(paths.select("path").distinct(), "path", "left_anti")
    return out


def affected_sources(changed: DataFrame, sources: DataFrame) -> DataFrame:
    """Enabled sources that a changed path (path) is, or stands under."""
    touched = changed.select(F.explode(ancestors(F.regexp_replace(F.replace("path", F.lit("\\"), F.lit("/")), "/+$", ""))).alias("path")).distinct()
    return sources.where("enabled").join(touched, "path", "left_semi")


# The query log, feedback and metering.


def log_queries(log: DataFrame, fresh: DataFrame) -> DataFrame:
    """The log with fresh rows at its end; a row whose id is known already is not logged again."""
    return log.unionByName(fresh.join(log.select("id"), "id", "left_anti").dropDuplicates(["id"]), allowMissingColumns=True)


def post_feedback(feedback: DataFrame, fresh: DataFrame, queries: DataFrame, nodes: DataFrame) -> DataFrame:
    """Feedback with fresh rows (query_id, node_id, reason, created_at[, signal]) whose query and node exist; the reason gives the signal that is not said."""
    signal = F.create_map(*[F.lit(x) for kv in SIGNALS.items() for x in kv])[F.col("reason")]
    known = checked(fresh, "reason", SIGNALS).join(queries.select(F.col("id").alias("query_id")), "query_id", "left_semi").join(nodes.select(F.col("id").alias("node_id")), "node_id", "left_semi")
    made = _default(known, signal=signal).select("query_id", "node_id", "reason", "signal", "created_at")
    return writes.upsert(feedback.select(made.columns), made, ("query_id", "node_id", "reason"), order="created_at")


def set_quotas(quotas: DataFrame, fresh: DataFrame, keys: DataFrame) -> DataFrame:
    """Quotas by key and period; limits below 0 and unknown keys are errors."""
    if not fresh.where("max_queries < 0 OR max_tokens < 0").isEmpty():
        raise ValueError("a limit is below 0")
    if not fresh.join(keys.select(F.col("id").alias("api_key_id")), "api_key_id", "left_anti").isEmpty():
        raise ValueError("a quota for an unknown key")
    return writes.upsert(quotas, _default(fresh, period=F.lit("monthly")).select(quotas.columns), ("api_key_id", "period"))


def create_keys(keys: DataFrame, fresh: DataFrame, now: int) -> DataFrame:
    """Keys with fresh ones (id, name, salt, raw); only the salted hash of a key is kept."""
    made = fresh.select("id", "name", salted_hash(F.col("salt"), F.col("raw")).alias("key_hash"), "salt", F.lit(now).cast("long").alias("created_at"), F.lit(None).cast("long").alias("revoked_at"))
    return writes.upsert(keys, made.select(keys.columns), ("id",), keep=("created_at",))


def revoke_keys(keys: DataFrame, ids: DataFrame, now: int) -> DataFrame:
    """Keys with some revoked; a key that was revoked before keeps its time."""
    j = keys.join(ids.select("id", F.lit(True).alias("_r")).distinct(), "id", "left")
    return j.withColumn("revoked_at", F.when(F.col("_r"), F.coalesce("revoked_at", F.lit(now).cast("long"))).otherwise(F.col("revoked_at"))).select(keys.columns)


def verified_keys(keys: DataFrame, presented: DataFrame, block: int = 4096) -> DataFrame:
    """(attempt, id) of presented keys (attempt, raw) that are active: the salted hash is compared with the stored one, salt by salt.

    Every attempt is hashed with every salt, as nothing in a raw key says which one is its own; both sides are dealt into blocks of about
    `block` rows, so that a task has one pair of blocks and neither side is broadcast.
    """
    active = keys.where("revoked_at IS NULL").select("id", "salt", "key_hash")
    salts = active.select("salt").distinct()
    na, ns = (max(1, -(-df.count() // block)) for df in (presented, salts))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = presented.select("attempt", "raw", F.pmod(F.xxhash64("raw"), F.lit(na)).cast("int").alias("_a"), every(ns).alias("_s"))
    right = salts.select("salt", F.pmod(F.xxhash64("salt"), F.lit(ns)).cast("int").alias("_s"), every(na).alias("_a"))
    hashed = left.join(right, ["_a", "_s"]).select("attempt", "salt", salted_hash(F.col("salt"), F.col("raw")).alias("key_hash"))
    return hashed.join(active, ["salt", "key_hash"]).select("attempt", "id")


# Small tables.


def touch_files(touched: DataFrame, fresh: DataFrame) -> DataFrame:
    """When each session touched each file last."""
    return touched.unionByName(fresh.select(touched.columns)).groupBy("session_id", "file_path").agg(F.max("touched_at").alias("touched_at")).select(touched.columns)


def stamp_evidence(ledger: DataFrame, fresh: DataFrame) -> DataFrame:
    """The ledger with fresh stamps by session, rule and step; the latest counts."""
    return writes.upsert(ledger, fresh.select(ledger.columns), ("session_id", "rule_id", "step"), order="stamped_at")


def set_mtimes(index: DataFrame, fresh: DataFrame) -> DataFrame:
    return writes.upsert(index, fresh.select(index.columns), ("path",), order="indexed_at")


def unread(files: DataFrame, index: DataFrame) -> DataFrame:
    """Files (path, mtime) that are new or newer than when they were read."""
    seen = index.select("path", F.col("mtime").alias("_seen"))
    return files.join(seen, "path", "left").where("_seen IS NULL OR mtime > _seen").select(files.columns)


def singleton(row: DataFrame) -> DataFrame:
    """A table of one row; an empty one clears it."""
    return row.limit(1)


def set_status(queue: DataFrame, changes: DataFrame) -> DataFrame:
    """The audit queue with some findings' status set (fingerprint, status)."""
    c = checked(changes, "status", STATUSES).select("fingerprint", F.col("status").alias("_to"))
    return queue.join(c, "fingerprint", "left").withColumn("status", F.coalesce("_to", "status")).select(queue.columns)


def grant(permissions: DataFrame, fresh: DataFrame) -> DataFrame:
    """Permissions with fresh ones; a null project means all, and meets null."""
    return writes.upsert(permissions, fresh.select(permissions.columns), ("project_key", "tool_name"), keep=("granted_ms",))


def revoke(permissions: DataFrame, gone: DataFrame) -> DataFrame:
    return writes.delete(permissions, gone.select(F.col("project_key").alias("_p"), F.col("tool_name").alias("_t")), {"project_key": "_p", "tool_name": "_t"})


def set_overrides(overrides: DataFrame, fresh: DataFrame) -> DataFrame:
    return writes.upsert(overrides, checked(fresh, "decision", DECISIONS).select(overrides.columns), ("source_path",), order="decided_ms")


def save_workspaces(workspaces: DataFrame, fresh: DataFrame) -> DataFrame:
    """Workspaces with fresh ones by id; their names must stay unique."""
    made = writes.upsert(workspaces, fresh.select(workspaces.columns), ("id",), keep=("created_ms",))
    if not made.groupBy("name").count().where("count > 1").isEmpty():
        raise ValueError("a workspace's name is taken")
    return made


def delete_workspaces(workspaces: DataFrame, state: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(workspaces, state): without some, and no active one where that is gone."""
    left = workspaces.join(ids.select("id").distinct(), "id", "left_anti")
    known = left.select(F.col("id").alias("active_id"), F.lit(True).alias("_k"))
    return left, state.join(known, "active_id", "left").select(F.when(F.col("_k"), F.col("active_id")).alias("active_id"))


def append_messages(messages: DataFrame, fresh: DataFrame) -> DataFrame:
    """Messages with fresh ones (conversation_id, at, ...) numbered on from each conversation's last."""
    from pyspark.sql.window import Window

    last = messages.groupBy("conversation_id").agg(F.max("seq").alias("_last"))
    k = F.row_number().over(Window.partitionBy("conversation_id").orderBy("at", "id"))
    made = fresh.join(last, "conversation_id", "left").withColumn("seq", (F.coalesce("_last", F.lit(-1)) + k).cast("long"))
    return messages.unionByName(made.select(messages.columns))


# Lookups.


def keys_of_file(nodes: DataFrame, files: DataFrame) -> DataFrame:
    """(file, source_path): the keys that a file (file) owns, its own and those of its parts."""
    own = F.regexp_replace(F.split_part("source_path", F.lit("::"), F.lit(1)), r":[0-9]+-[0-9]+$", "")
    return nodes.select("source_path", own.alias("file")).join(files.select("file").distinct(), "file").select("file", "source_path").distinct()


def legacy_units(nodes: DataFrame, file: str, kind: str, name: str) -> DataFrame:
    """Code nodes of a type and name whose key still is `file:first-last`."""
    path = F.col("source_path")
    return nodes.where((F.col("type") == kind) & (F.col("name") == name) & F.startswith(path, F.lit(f"{file}:")) & F.substring(path, len(file) + 2, 1 << 20).rlike("^[0-9]+-[0-9]+$"))


def active_workspace(workspaces: DataFrame, state: DataFrame) -> DataFrame:
    """All workspaces with a flag at the active one."""
    return workspaces.join(F.broadcast(state.limit(1).select(F.col("active_id").alias("id"), F.lit(True).alias("active"))), "id", "left").withColumn("active", F.coalesce("active", F.lit(False)))


def finding_labels(findings: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node_id, name, type, source_path) of every existing node that findings cite, once."""
    cited = findings.select(F.explode("node_ids").alias("node_id")).distinct()
    return cited.join(nodes.select(F.col("id").cast("string").alias("node_id"), "name", "type", "source_path"), "node_id")


def scope_of(callers: DataFrame, sources: DataFrame, nodes: DataFrame) -> DataFrame:
    """(caller, project_key) of callers (caller, cwd): the key made of the folder's path, and those of sources at, above or below it, that own nodes.

    Folders above are the caller's ancestors, folders below have the caller among their ancestors: two equalities. Keys are gathered by folder
    before callers meet them, so that a folder's callers are multiplied by its keys and not by its sources.
    """
    from quillon.functions.text import project_key

    plain = lambda c: F.lower(F.regexp_replace(F.replace(c, F.lit("\\"), F.lit("/")), "/+$", ""))
    c = callers.where("cwd IS NOT NULL AND cwd <> ''").select("caller", "cwd", plain(F.col("cwd")).alias("at"))
    owning = nodes.where("project_key IS NOT NULL").select("project_key").distinct()
    s = sources.where("project_key IS NOT NULL").select(plain(F.col("path")).alias("root"), "project_key").distinct().join(owning, "project_key", "left_semi")
    above = c.select("caller", F.explode(ancestors(F.col("at"))).alias("root")).join(s, "root").select("caller", "project_key")
    below = s.select("project_key", F.explode(ancestors(F.col("root"))).alias("at")).distinct().join(c, "at").select("caller", "project_key")
    made = c.select("caller", project_key(F.col("cwd")).alias("project_key")).join(owning, "project_key", "left_semi").select("caller", "project_key")
    return made.unionByName(above).unionByName(below).distinct()


def identity_report(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row: nodes (id, source_path) that got a new key, went away, or came."""
    j = before.select("id", F.col("source_path").alias("_a")).join(after.select("id", F.col("source_path").alias("_b")), "id", "full_outer")
    n = lambda c: F.count_if(c).alias
    return j.agg(n(F.col("_a").isNotNull())("before"), n(F.col("_b").isNotNull())("after"), n(F.col("_a") != F.col("_b"))("rekeyed"), n(F.col("_a").isNotNull() & F.col("_b").isNull())("orphaned"), n(F.col("_a").isNull())("new"))


# Fixing a finding: a preview, then a write that the preview's hash guards.


def fix_preview(findings: DataFrame, nodes: DataFrame, prefix: str = "ref") -> DataFrame:
    """(fingerprint, node_id, body_hash, after, removed, reason) of orphan findings: the citing body without its dead citations.

    A citation is dead where its target is shaped as an id and no node has it; blanks before it go with it. reason is null where there is
    something to write.
    """
    f = findings.select("fingerprint", "type", F.get("node_ids", F.lit(0)).alias("node_id"), F.filter(F.split(F.coalesce("locus", F.lit("")), ","), lambda x: x != "").alias("targets"))
    there = f.select("fingerprint", F.explode("targets").alias("_t")).join(nodes.select(F.col("id").cast("string").alias("_t")), "_t").groupBy("fingerprint").agg(F.collect_set("_t").alias("have"))
    j = f.join(there, "fingerprint", "left").join(nodes.select(F.col("id").cast("string").alias("node_id"), "body"), "node_id", "left")
    missing = F.array_except("targets", F.coalesce("have", F.array().cast("array<string>")))
    j = j.withColumns({"missing": missing, "before": F.coalesce("body", F.lit(""))}).withColumn("dead", F.filter("missing", lambda t: node_id_shape(t) & F.contains("before", F.concat(F.lit(f"[{prefix}:"), t, F.lit("]")))))
    after = F.aggregate("dead", F.col("before"), lambda text, t: F.regexp_replace(text, F.concat(F.lit(rf"\s*\[{prefix}:"), t, F.lit(r"\]")), F.lit("")))
    reason = (
        F.when(F.col("type") != "orphan_reference", "unsupported").when(F.col("body").isNull(), "node_gone").when(F.size("dead") > 0, F.lit(None))
        .when(F.size("missing") == 0, "no_longer_orphaned").when(~F.exists("missing", node_id_shape), "placeholder").otherwise("nothing_to_strip")
    )
    return j.select("fingerprint", "node_id", F.sha1(F.col("before").cast("binary")).alias("body_hash"), F.when(reason.isNull(), after).otherwise(F.col("before")).alias("after"), F.when(reason.isNull(), F.col("dead")).otherwise(F.array().cast("array<string>")).alias("removed"), reason.alias("reason"))


def apply_fixes(confirmed: DataFrame, findings: DataFrame, nodes: DataFrame, now: int, prefix: str = "ref") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, findings, outcome (fingerprint, applied, reason)) after fixes that were confirmed (fingerprint, body_hash).

    A body that is another one than in the preview is left alone (stale), as is a finding without anything to write.
    """
    p = fix_preview(findings, nodes, prefix)
    asked = confirmed.select("fingerprint", F.col("body_hash").alias("_seen")).join(p, "fingerprint", "left")
    reason = F.when(F.col("node_id").isNull() & F.col("after").isNull(), "unknown").when(F.col("reason").isNotNull(), F.col("reason")).when(F.col("_seen") != F.col("body_hash"), "stale")
    outcome = asked.select("fingerprint", "node_id", "after", reason.isNull().alias("applied"), reason.alias("reason"))
    done = outcome.where("applied")
    bodies = done.groupBy("node_id").agg(F.min_by("after", F.struct(F.length("after"), F.col("fingerprint"))).alias("_body"))
    fresh = nodes.join(bodies.select(F.col("node_id").alias("_n"), "_body"), F.col("id").cast("string") == F.col("_n"), "left")
    updated = fresh.withColumns({"body": F.coalesce("_body", "body"), "updated_at": F.when(F.col("_body").isNotNull(), F.lit(now).cast("long")).otherwise(F.col("updated_at"))}).select(nodes.columns)
    resolved = findings.join(done.select("fingerprint", F.lit(True).alias("_d")), "fingerprint", "left").withColumn("status", F.when(F.col("_d"), "resolved").otherwise(F.col("status"))).select(findings.columns)
    return updated, resolved, outcome.select("fingerprint", "applied", "reason")
