"""Run results: one input row per plan and one output row per answer."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def run_tables(outputs: DataFrame):
    """(run_inputs, run_outputs) from rows of plan_id, gen_idx, condition, tokens, plan, elapsed_sec, summary."""
    rows = outputs.select(
        "run_id", "plan_id", F.col("gen_idx").alias("index"),
        F.array_join("tokens", " ").alias("token_text"), F.size("tokens").alias("output_token_count"),
        F.round("elapsed_sec", 3).alias("elapsed_sec"), F.col("plan").isNotNull().alias("parse_success"),
        F.to_json("plan").alias("plan_json"), "summary", F.size("condition").alias("input_token_count"),
        F.array_join("condition", " ").alias("condition_text"),
    )
    inputs = rows.groupBy("run_id", "plan_id").agg(
        F.min("summary").alias("augmentation"), F.min("input_token_count").alias("input_token_count"),
        F.min("condition_text").alias("condition_text"), F.count(F.lit(1)).alias("num_outputs"),
    )
    return inputs, rows.drop("summary", "input_token_count", "condition_text")


def meta_json(inputs: DataFrame, outputs: DataFrame) -> DataFrame:
    """One JSON per plan: flat for a single output, a list of outputs otherwise."""
    listed = outputs.groupBy("run_id", "plan_id").agg(
        F.array_sort(F.collect_list(F.struct("index", "output_token_count", "elapsed_sec", "parse_success"))).alias("o")
    )
    return inputs.join(listed, ["run_id", "plan_id"]).select(
        "run_id", "plan_id",
        F.when(
            F.col("num_outputs") == 1,
            F.expr(
                "to_json(named_struct('plan_id', plan_id, 'augmentation', augmentation, 'input_token_count', input_token_count,"
                " 'output_token_count', o[0].output_token_count, 'elapsed_sec', o[0].elapsed_sec, 'parse_success', o[0].parse_success))"
            ),
        ).otherwise(
            F.expr(
                "to_json(named_struct('plan_id', plan_id, 'augmentation', augmentation, 'input_token_count', input_token_count,"
                " 'num_outputs', num_outputs, 'outputs', o))"
            )
        ).alias("meta"),
    )


def write_runs(inputs: DataFrame, outputs: DataFrame, folder: str, mode: str = "append") -> None:
    stamp = F.current_timestamp()
    inputs.withColumn("timestamp", stamp).write.mode(mode).partitionBy("run_id").parquet(f"{folder}/run_inputs")
    outputs.write.mode(mode).partitionBy("run_id").parquet(f"{folder}/run_outputs")
