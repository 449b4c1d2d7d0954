"""Schemas of the pipeline's files."""

from __future__ import annotations

from pyspark.sql import types as T

S, L, I, D, B = T.StringType(), T.LongType(), T.IntegerType(), T.DoubleType(), T.BooleanType()


def struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


EVIDENCE = struct(author=S, category=S, fact=S, published_at=S, source=S, title=S, url=S, evidence_id=S)
TURN = struct(role=S, content=S)
SESSION = struct(session_id=S, source_question_id=S, evidence_id=S, session=T.ArrayType(TURN), source=S, is_off_topic=B, date=S)
DOCUMENT = struct(url=S, title=S, body=S, category=S, author=S, source=S, published_at=S)
EVIDENCE_URL = struct(evidence_id=S, url=S, question_idx=S)
DIVERSITY = struct(scenario=S, scenario_category=S, turn_range=T.ArrayType(I), evidence_placement=S, topic_drift=S, evidence_density=S, human_message=S)
MANIFEST = struct(source_question_id=S, evidence_id=S, query_fingerprint=S, query=S, answer=S, question_type=S, original_persona_id=S, target_persona_id=S, persona_character=S, evidence=EVIDENCE, diversity=DIVERSITY, is_temporal=B, is_off_topic=B)
_CONTENT = struct(text=S)
BATCH_OUTPUT = struct(custom_id=S, error=S, response=struct(status_code=I, body=struct(output=T.ArrayType(struct(content=T.ArrayType(_CONTENT))))))
TURNS = struct(turns=T.ArrayType(TURN))
RETRIEVED = struct(text=S, session_id=S, url=S, score=D, source_type=S)
RUN = struct(question_idx=I, block_id=I, original_persona=S, eval_persona=S, variant=S, agent=S, query=S, prediction=S, gold_answer=S, question_type=S, latency_s=D, input_tokens=I, output_tokens=I, total_tokens=I, golden_memory_session_ids=T.ArrayType(S), golden_document_urls=T.ArrayType(S), retrieved_memory=T.ArrayType(RETRIEVED), retrieved_documents=T.ArrayType(RETRIEVED))
AUDIT = struct(session_id=S, evidence_id=S, source_question_id=S, is_temporal=B, topic=T.ArrayType(I), source=T.ArrayType(I), key_information=T.ArrayType(I), published_at=T.ArrayType(I), notes=S, all_required_present=B, error=S)
_SETS = T.ArrayType(EVIDENCE)
QUESTION = struct(question_idx=S, question_id=S, query=S, gold_answer=S, question_type=S, original_persona=S, hop_count=I, memory_evidence=_SETS, evidence_list=_SETS, golden_memory_evidence=_SETS, golden_document_evidence=_SETS)
DESIGN = struct(Block1=I, dist=S, agent=S, persona=S)


def strict_schema(node: object) -> object:
    """A JSON schema whose objects with properties allow no others, at any depth; the given one is left as it is."""
    if isinstance(node, list):
        return [strict_schema(x) for x in node]
    if not isinstance(node, dict):
        return node
    closed = {"additionalProperties": False} if node.get("type") == "object" and "properties" in node else {}
    return {key: strict_schema(value) for key, value in node.items()} | closed
