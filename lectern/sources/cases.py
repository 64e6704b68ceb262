"""Evaluation cases from JSON lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = """case_id string, schema_version int, split string, query string, filters struct<books: array<string>, reference_ranges: array<string>>,
curator_rationale string, non_authoritative_notes string, judgments array<struct<reference: string, grade: int>>"""


def cases_from_lines(lines: DataFrame) -> DataFrame:
    """Cases of lines (value), blank ones skipped; a line that is no case ends the job with the line's text."""
    rows = lines.where(F.trim("value") != "").withColumn("_case", F.from_json("value", SCHEMA))
    c = F.col("_case")
    query_length = F.length(F.trim(c["query"]))
    good = (
        c["case_id"].rlike(r"^[A-Za-z0-9._-]{1,128}$") & c["split"].isin("development", "locked") & query_length.between(1, 512) & (F.length(c["curator_rationale"]) >= 1)
        & F.forall(F.coalesce(c["judgments"], F.array().cast("array<struct<reference:string,grade:int>>")), lambda j: j["grade"].between(0, 3))
    )
    checked = F.when(F.coalesce(good, F.lit(False)), c).otherwise(F.raise_error(F.concat(F.lit("invalid evaluation case: "), F.col("value"))).cast(rows.schema["_case"].dataType))
    return rows.select(checked.alias("c")).select("c.*").withColumn("schema_version", F.coalesce("schema_version", F.lit(1))).withColumn("query", F.trim("query"))


def load_cases(spark: SparkSession, path: str) -> DataFrame:
    """Cases of a file of JSON lines; ids must be unique."""
    found = cases_from_lines(spark.read.text(path))
    twice = found.groupBy("case_id").count().where("count > 1").limit(1).collect()
    if twice:
        raise ValueError(f"case {twice[0].case_id} occurs more than once")
    return found


def judgments(cases: DataFrame) -> DataFrame:
    return cases.select("case_id", F.inline("judgments"))
