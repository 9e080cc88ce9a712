"""Evaluation sets: a JSON file with thresholds and cases."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.functions import text as tx

_SCHEMA = """
  name string, version int, minimumRecallAt5 double, minimumMrrAt10 double,
  minimumNdcgAt10 double, minimumHitRateAt5 double, minimumRecallAt20 double,
  cases array<struct<id:string,query:string,language:string,expectedDocuments:array<string>,
    expectedPassages:array<string>,mustNotReturn:array<string>,category:string,split:string,
    hardNegatives:array<string>,answerable:boolean>>"""


def read_evaluation_set(spark: SparkSession, path: str) -> tuple[dict[str, float], DataFrame]:
    """(thresholds, cases) of a checked evaluation set."""
    data = spark.read.schema(_SCHEMA).option("multiLine", "true").json(path)
    head = data.select("name", "version", F.size("cases").alias("n"), "minimumRecallAt5",
                       "minimumMrrAt10", "minimumNdcgAt10",
                       F.coalesce("minimumHitRateAt5", "minimumRecallAt5").alias("hit"),
                       F.coalesce("minimumRecallAt20", "minimumRecallAt5").alias("r20")).first()
    thresholds = {"min_recall5": head.minimumRecallAt5, "min_mrr10": head.minimumMrrAt10,
                  "min_ndcg10": head.minimumNdcgAt10, "min_hit5": head.hit,
                  "min_recall20": head.r20}
    if not (head.name or "").strip() or (head.version or 0) < 1 or (head.n or 0) < 1:
        raise ValueError("an evaluation set needs a name, a version and cases")
    if any(not 0 <= value <= 1 for value in thresholds.values()):
        raise ValueError("thresholds lie between 0 and 1")
    return thresholds, checked_cases(data.select(F.inline("cases")))


def checked_cases(raw: DataFrame) -> DataFrame:
    """Defaults filled in; a case without a required text, or answerable without an expected
    document, stops the job."""
    def texts(name: str):
        return F.coalesce(F.col(name), F.array().cast("array<string>"))

    def required(name: str):
        value = tx.strip(F.coalesce(F.col(name), F.lit("")))
        return F.when(value == "", F.raise_error(F.lit(f"case without {name}"))).otherwise(value)

    answerable = F.coalesce("answerable", F.lit(True))
    split = tx.strip(F.coalesce("split", F.lit("")))
    expected = F.when(answerable & (F.size(texts("expectedDocuments")) == 0), F.raise_error(
        F.lit("answerable case without expected documents"))).otherwise(
        texts("expectedDocuments"))
    return raw.select(
        required("id").alias("case_id"), required("query").alias("query"),
        required("language").alias("language"), required("category").alias("category"),
        F.when(split == "", "test").otherwise(split).alias("split"),
        answerable.alias("answerable"), expected.alias("expected_documents"),
        texts("expectedPassages").alias("expected_passages"),
        texts("mustNotReturn").alias("must_not_return"),
        texts("hardNegatives").alias("hard_negatives"))
