"""Explicit schemas of all tables.  Nothing is inferred."""

from pyspark.sql import types as T

S, I, L, D, B, TS = (T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType(),
                     T.BooleanType(), T.TimestampType())
TEXTS = T.ArrayType(S)
TEXT_MAP = T.MapType(S, S)


def struct(**fields) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields.items()])


RAW_CHUNK = struct(doc=S, source_file=S, text=S, page=I, category=S, question=S)
CHUNK = struct(id=S, doc=S, source_file=S, page=I, block_type=S, provenance=S, index_text=S,
               display_text=S, text=S, metadata=TEXT_MAP)
BLOCK = struct(doc_id=S, pos=L, type=S, text=S, content=S, image_path=S, page_idx=I, page_scan=B)
CHUNK_RECORD = struct(chunk_id=S, document_id=S, language=S, title=S, section=S,
                      entities=TEXT_MAP, domain=S, source_type=S, role_scope=TEXTS,
                      orchard_scope=TEXTS, text=S)
TERM = struct(category=S, category_ord=I, alias_ord=I, alias=S, canonical=S)
CONCEPT = struct(canonical_id=S, type=S, canonical_name=S,
                 aliases=struct(zh=TEXTS, en=TEXTS, th=TEXTS, ms=TEXTS),
                 related_entities=TEXTS, source_categories=TEXTS)
GOLD_RAW = struct(question=S, q_lang=S, language=S, category=S, difficulty=S, cross_lingual=B,
                  ref_doc_id=S, anchors=TEXTS, gold_answer=S)
INTENT_SAMPLE = struct(query=S, language=S, intent=S, rule_backstop=B)
PAGE_TEXT = struct(doc=S, page=I, text=S)
MESSAGE = struct(conv_id=L, turn=L, role=S, text=S)
TRACE = struct(
    trace_id=S, thread_id=S, user_id=S, tenant_id=S, route=S, intent=S, tool_sequence=TEXTS,
    retrieval_latency_ms=D, retrieval_sources=TEXTS, rrf_ranks=T.MapType(S, I),
    reranker_scores=T.MapType(S, D), evidence_decision=S, token_input=I, token_output=I,
    memory_compressions=I, fallback_count=I, final_success=B, last_error=S)

OPS = {
    "users": struct(user_id=S, tenant_id=S, role=S, display_name=S, orchard_scope=S,
                    created_at=TS),
    "roles": struct(role=S, description=S),
    "permissions": struct(role=S, tool_name=S),
    "orchards": struct(orchard_id=S, tenant_id=S, name=S, area_ha=D),
    "plots": struct(plot_id=S, orchard_id=S, cultivar=S, trees=I),
    "tasks": struct(task_id=S, title=S, description=S, orchard=S, plot=S, priority=S, status=S,
                    assignee=S, idempotency_key=S, created_by=S, created_at=TS),
    "tool_audit": struct(audit_id=L, trace_id=S, thread_id=S, user_id=S, tool_name=S,
                         arguments=S, status=S, created_at=TS),
    "conversation_metadata": struct(thread_id=S, tenant_id=S, user_id=S, route=S,
                                    updated_at=TS),
}
OPS_DEFAULTS = {
    "users": {"tenant_id": "default", "role": "worker", "display_name": "", "orchard_scope": ""},
    "roles": {"description": ""},
    "permissions": {},
    "orchards": {"tenant_id": "default", "name": "", "area_ha": 0.0},
    "plots": {"cultivar": "", "trees": 0},
    "tasks": {"description": "", "orchard": "", "plot": "", "priority": "normal",
              "status": "pending", "assignee": "", "created_by": ""},
    "tool_audit": {"trace_id": "", "thread_id": "", "user_id": "", "arguments": "{}",
                   "status": ""},
    "conversation_metadata": {"tenant_id": "default", "user_id": "", "route": ""},
}
