"""Folders of token text, one condition per file."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from planmill.operators.parse import parse_condition


def read_token_files(spark: SparkSession, folder: str, pattern: str = "*.txt") -> DataFrame:
    """(plan_id = file stem, condition, plan); a file that cannot be parsed gives an empty plan."""
    files = spark.read.option("pathGlobFilter", pattern).text(folder, wholetext=True)
    stem = F.regexp_replace(F.col("_metadata.file_name"), r"\.[^.]*$", "")
    tokens = F.expr("regexp_extract_all(value, '<[^<>]+>|[^\\\\s<>]+', 0)")
    parsed = parse_condition(files.select(stem.alias("plan_id"), tokens.alias("condition")), "condition")
    empty = F.expr("from_json('{\"rooms\":[],\"edges\":[],\"spatial\":[]}', '" + parsed.schema["plan"].dataType.simpleString() + "')")
    return parsed.withColumn("plan", F.coalesce("plan", empty))
