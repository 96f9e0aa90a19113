"""The pN_ queries of the text operators (problems 2, 7, 8, 9) and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from isotrek.llm.lookalikes import look_alike_pairs, read_pairs
from isotrek.llm.passages import leaked_passages
from isotrek.llm.reading import reading_grades
from isotrek.llm.tokens import encode_texts
from isotrek.session import table

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"


def tokenizer_path(spark: SparkSession) -> str:
    return spark.conf.get("spark.isotrek.tokenizer", TOKENIZER)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Look-alikes of the file named in spark.isotrek.confusables, if any, are added to the fixed ones."""
    file = spark.conf.get("spark.isotrek.confusables", None)
    pairs = look_alike_pairs(table(spark, d, "stops"), "stop_id", "stop_name", read_pairs(file) if file else ())
    return pairs.select(F.col("id_a").alias("stop_id_a"), F.col("id_b").alias("stop_id_b"))


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode_texts(table(spark, d, "documents"), "doc_id", "text", tokenizer_path(spark))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return p8_passages(spark, d).filter("field = 'prompt'").select("doc_id", "item_id").distinct()


def p8_passages(spark: SparkSession, d: str) -> DataFrame:
    """Cell, part and character offsets of every leaked passage of a prompt or an answer."""
    return leaked_passages(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return p9_difficulty(spark, d).select("doc_id", "grade")


def p9_difficulty(spark: SparkSession, d: str) -> DataFrame:
    """Grade and continuous difficulty of the English documents."""
    documents = table(spark, d, "documents").filter(F.trim("lang") == "en")
    return reading_grades(documents, table(spark, d, "graded_texts"), table(spark, d, "eval_items"))


QUERIES = {f.__name__: f for f in (p2_found, p7_ids, p8_found, p8_passages, p9_found, p9_difficulty)}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return {}
