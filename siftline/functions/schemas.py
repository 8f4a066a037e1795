"""Declared schemas of the record tables; readers never infer."""

_PASSAGE = "STRUCT<docid:STRING, text:STRING, title:STRING>"
_NEGATIVE = "STRUCT<docid:STRING, text:STRING, title:STRING, explanation:STRING>"
_DOC = "STRUCT<id:STRING, text:STRING, title:STRING>"

GENERATED = (
    "query_id BIGINT, original_query STRING, original_positive_id BIGINT, original_negative_id BIGINT, status STRING, error STRING, "
    "generated_instruction_text STRING, "
    "instruction_data STRUCT<rewritten_query:STRING, rewritten_pos_doc:STRING, rewritten_pos_title:STRING, rewritten_neg_doc:STRING, "
    "rewritten_neg_title:STRING, reasoning:STRING, instruction:STRING, relevant_docs:ARRAY<BIGINT>, non_relevant_docs:ARRAY<BIGINT>>, "
    "mining_data STRUCT<reasoning:STRING, documents:ARRAY<STRUCT<matches_both:BOOLEAN, error_type:STRING, explanation:STRING, title:STRING, passage:STRING>>>"
)
FILTERED = (
    "query_id BIGINT, original_query STRING, rewritten_query STRING, instruction STRING, "
    "final_positive STRUCT<id:STRING, text:STRING, title:STRING, source:STRING>, "
    f"valid_synthetic_negatives ARRAY<{_DOC}>, rewritten_original_positive {_DOC}, rewritten_original_negative {_DOC}"
)
TRAINING = (
    f"query_id STRING, query STRING, positive_passages ARRAY<{_PASSAGE}>, negative_passages ARRAY<{_NEGATIVE}>, "
    f"only_instruction STRING, only_query STRING, has_instruction BOOLEAN, new_negatives ARRAY<{_NEGATIVE}>, is_repeated BOOLEAN"
)
CORPUS = "docid STRING, text STRING, title STRING"
QRELS = "qid STRING, docid STRING, rel INT"
RUN = "qid STRING, docid STRING, score DOUBLE"
CANDIDATES = "qid STRING, docid STRING"
METRICS = "model STRING, dataset STRING, topic STRING, metric STRING, value DOUBLE"
