"""Queries of the language-model operators (problems 3, 6, 7 and 8) and their SQL twins."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelmill.functions.scalar import is_finite
from panelmill.llm.bpe import encode_texts
from panelmill.llm.packing import pack_documents
from panelmill.llm.subjects import assign_subjects
from panelmill.llm.topn import top_n_latest
from panelmill.session import written
from panelmill.sources.tables import table

#: Vocabulary file of byte_bpe_50k; the same path on every worker.
VOCABULARY = os.environ.get("PANELMILL_VOCABULARY", "/opt/tokenizers/byte_bpe_50k.json")
#: Tokens of a container, and documents packed together (they bound a task's memory).
CAPACITY, SHARD_DOCUMENTS = 8192, 10_000

GROUP = ["model", "variant", "timestamp"]


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    order = [("prediction", True), ("symbol", False), ("member", False)]
    best = top_n_latest(
        table(spark, d, "predictions"), 3, GROUP, ["symbol", "member"], ["loaded_at", "pred_id"], order, ["prediction", "pred_id"], is_finite(F.col("prediction"))
    )
    return best.select("pred_id")


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode_texts(table(spark, d, "documents"), VOCABULARY)


def p7_containers(spark: SparkSession, d: str) -> DataFrame:
    documents = table(spark, d, "documents")
    shards = max(1, -(-documents.count() // SHARD_DOCUMENTS))  # row count from the file footers
    return pack_documents(encode_texts(documents, VOCABULARY, counts_only=True), CAPACITY, shards)


def p7_audit(spark: SparkSession, d: str) -> DataFrame:
    """What must hold of any packing: every document once, whole unless it exceeds a container, no container over its capacity."""
    packed = written(p7_containers(spark, d), "containers")  # read three times below
    size, parts = F.sum("n_tokens"), F.count("*")
    by_container = packed.groupBy("container").agg(size.alias("size")).agg(F.count_if(F.col("size") > CAPACITY).alias("containers_over_capacity"))
    rows = packed.groupBy("doc_id").agg(
        F.count_if(F.col("part") == 0).alias("copies"), parts.alias("parts"), size.alias("size"), F.count_if(F.col("first_token") != F.col("part") * CAPACITY).alias("misplaced")
    )
    needed = F.greatest(F.ceil(F.col("size") / F.col("copies") / CAPACITY), F.lit(1)) * F.col("copies")
    by_document = rows.agg(F.sum("copies").alias("documents"), F.count_if((F.col("parts") != needed) | (F.col("misplaced") > 0)).alias("documents_cut_wrongly"))
    missing = table(spark, d, "documents").select("doc_id").join(packed, "doc_id", "left_anti").agg(F.count("*").alias("documents_missing"))
    return by_document.crossJoin(by_container).crossJoin(missing)  # one-row frames


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return assign_subjects(table(spark, d, "documents"), table(spark, d, "subject_labels"), table(spark, d, "subjects"))


QUERIES = {f.__name__: f for f in (p3_found, p6_ids, p7_containers, p7_audit, p8_found)}

ORACLE = {
    "p7_audit": """
      SELECT count(*) AS documents, 0 AS documents_cut_wrongly, 0 AS containers_over_capacity, 0 AS documents_missing FROM documents""",
    "p3_found": """
      WITH latest AS (
        SELECT * FROM predictions
        QUALIFY row_number() OVER (PARTITION BY model, variant, "timestamp", symbol, member ORDER BY loaded_at DESC NULLS LAST, pred_id DESC) = 1)
      SELECT pred_id FROM latest WHERE isfinite(prediction)
      QUALIFY row_number() OVER (PARTITION BY model, variant, "timestamp" ORDER BY prediction DESC, symbol, member) <= 3""",
}
