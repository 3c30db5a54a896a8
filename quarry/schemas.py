"""Explicit types of the stored records; nothing is inferred when reading."""

from __future__ import annotations

from pyspark.sql import types as T

S, L, D, B, TS = T.StringType(), T.LongType(), T.DoubleType(), T.BooleanType(), T.TimestampType()


def struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


PROVENANCE = struct(type=S, ref=S)
MEMORY_ITEM = struct(
    id=S, kind=S, scope=S, source=S, confidence=D, confidence_rationale=S, status=S, content=S, created_at=TS, updated_at=TS,
    verified_at=TS, source_content_hash=S, retrieval_count=T.IntegerType(), last_retrieved_at=TS, cross_project_applicable=B,
    references=T.ArrayType(S), expires_at=TS, semantic_tags=T.ArrayType(S), provenance=T.ArrayType(PROVENANCE),
)
RESOURCE = struct(kind=S, ref=S, access=S, version_ref=S)
EVENT = struct(
    event_id=S, kind=S, text=S, source_ref=S, call_id=S, task_revision=S, task_id=S, goal_id=S, source_role=S,
    parent_event_id=S, parent_episode_id=S, resources=T.ArrayType(RESOURCE),
)
FEEDBACK = struct(
    check_id=S, project_id=S, run_id=S, criterion_id=S, task_revision=S, evaluated_state_digest=S, evaluator_status=S, outcome=S,
    score=D, source=S, visibility=S, evidence_refs=T.ArrayType(S), reason=S, checked_at=TS, received_at=TS, binding_status=S,
)
USAGE = struct(usage_id=S, exclusive_stage=S, monetary_cost=D, currency=S, time=D, tokens=struct(input_tokens=L, output_tokens=L, total_tokens=L))
CONTROLLER_FEEDBACK = struct(timestamp=TS, trigger=S, mode=S, deterministicScore=D, structureScore=D, items=L, reportPath=S)
