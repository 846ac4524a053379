"""Tables of the knowledge graph: columns, enumerations and defaults."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Spark DDL of every table. Times end in _at: epoch seconds, _ms: milliseconds.
TABLES: dict[str, str] = {
    "nodes": "id string, type string, name string, description string, body string, source_path string, source_kind string, project_key string, frontmatter_json string, hash string, created_at long, updated_at long, base boolean, local_only boolean",
    "edges": "src_id string, dst_id string, relation string, weight double, created_at long, source string, confidence double",
    "sources": "path string, kind string, project_key string, last_indexed_at long, enabled boolean, include string, exclude string",
    "queries": "id string, prompt string, intent_tags array<string>, retrieved_ids array<string>, scores map<string,double>, ts long, embedding array<float>, score_components map<string,struct<vector:double,graph:double,recency:double,type:double,project:double,lexical:double>>",
    "active_project": "project_key string, path string, since long",
    "feedback_event": "id string, query_id string, node_id string, signal double, reason string, created_at long",
    "workspaces": "id string, name string, project_keys array<string>, filter_prefs map<string,string>, page_state map<string,string>, created_ms long, updated_ms long",
    "workspace_state": "active_id string",
    "source_overrides": "source_path string, decision string, reason string, decided_ms long",
    "graph_layout": "scope_key string, fingerprint string, positions array<double>",
    "chat_conversations": "id string, name string, project_key string, page_context string, provider string, model string, created_ms long, updated_ms long, archived_ms long, summary_json string, tokens_total long",
    "chat_messages": "id string, conversation_id string, seq long, role string, content_json string, token_in long, token_out long, cache_read long, created_ms long",
    "chat_permissions": "project_key string, tool_name string, granted_ms long",
    "chat_bookmarks": "id string, conversation_id string, message_seq long, label string, created_ms long",
    "api_key": "id string, name string, key_hash string, salt string, created_at long, revoked_at long",
    "quota": "api_key_id string, period string, max_queries long, max_tokens long",
    "usage_period": "api_key_id string, period string, queries long, tokens long, updated_at long",
    "audit_queue": "fingerprint string, type string, severity string, node_ids array<string>, description string, locus string, status string, first_seen long, last_seen long",
    "file_index": "path string, mtime double, indexed_at long",
    "governance_ledger": "session_id string, rule_id string, step string, status string, evidence string, touched_files array<string>, stamped_at double",
    "governance_touched": "session_id string, file_path string, touched_at double",
    "schema_version": "version int",
    "node_terms": "node_id string, term string, tf long",
    "node_lengths": "node_id string, dl long",
    "chunks": "node_id string, chunk_idx int, chunk_text string, embedding array<float>",
}
KEYS: dict[str, tuple[str, ...]] = {
    "nodes": ("id",), "edges": ("src_id", "dst_id", "relation"), "sources": ("path",), "queries": ("id",), "feedback_event": ("query_id", "node_id", "reason"),
    "workspaces": ("id",), "source_overrides": ("source_path",), "graph_layout": ("scope_key",), "chat_conversations": ("id",), "chat_messages": ("conversation_id", "seq"),
    "chat_permissions": ("project_key", "tool_name"), "chat_bookmarks": ("id",), "api_key": ("id",), "quota": ("api_key_id", "period"), "usage_period": ("api_key_id", "period"),
    "audit_queue": ("fingerprint",), "file_index": ("path",), "governance_ledger": ("session_id", "rule_id", "step"), "governance_touched": ("session_id", "file_path"),
    "chunks": ("node_id", "chunk_idx"),
}
#: Relations that hold both ways, and those that pass relevance on. Fixed values.
SYMMETRIC_RELATIONS = ("applies_to", "co_occurs_with")
PROXIMITY_RELATIONS = ("applies_to", "co_occurs_with", "supersedes", "derived_from")
#: Relations of edges, and decisions on sources. Fixed values.
EDGE_RELATIONS = (
    "applies_to", "derived_from", "contradicts", "supersedes", "mentions", "co_occurs_with", "refines", "references_function", "motivated_by",
    "closed_by", "defines", "method_of", "imports", "calls", "routes_to", "renders", "at_endpoint",
)
DECISIONS = ("always_skip", "always_keep", "retry")
#: States of a finding. Fixed values.
STATUSES = ("open", "dismissed", "resolved")
#: Weight of each feedback reason. Fixed values.
SIGNALS = {"thumbs_up": 1.0, "thumbs_down": -1.0, "cite_copied": 0.5, "inferred_requery": -0.5}
EXPLICIT = ("thumbs_up", "thumbs_down")
#: Order of severities and of modalities. Fixed values.
SEVERITY_RANK = {"high": 0, "medium": 1, "low": 2, "candidate": 3}
MODALITY_RANK = {"MUST_NOT": 3, "MUST": 2, "SHOULD": 1}


def empty(spark, name: str) -> DataFrame:
    return spark.createDataFrame([], TABLES[name])


def conform(df: DataFrame, name: str, defaults: dict[str, Column] | None = None) -> DataFrame:
    """df with exactly the columns of a table: missing ones get their default or null (additive migration)."""
    defaults = defaults or {}
    columns = [c.strip().split(" ", 1) for c in _columns(TABLES[name])]
    return df.select(*[(F.col(c) if c in df.columns else defaults.get(c, F.lit(None))).cast(t).alias(c) for c, t in columns])


def _columns(ddl: str) -> list[str]:
    out, depth, start = [], 0, 0
    for k, ch in enumerate(ddl):
        depth += (ch == "<") - (ch == ">")
        if ch == "," and not depth:
            out.append(ddl[start:k])
            start = k + 1
    return [*out, ddl[start:]]


def invalid(df: DataFrame, column: str, allowed) -> DataFrame:
    """Rows whose value is outside an enumeration."""
    return df.where(F.col(column).isNull() | ~F.col(column).isin(*allowed))
