"""Chat text, loss-masked training rows and batch padding."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from planmill.constants import MAX_LENGTH, SYSTEM_PROMPT
from planmill.operators.rows import keep_rows

IGNORE = -100
TEMPLATE = "<|im_start|>{role}\n{text}<|im_end|>\n"


def render_chat(turns, generation_prompt: bool = False, template: str = TEMPLATE):
    """Column of chat text from (role, column) pairs; `template` has {role} and {text}."""
    head, tail = template.split("{text}")
    parts = []
    for role, column in turns:
        parts += [F.lit(head.format(role=role)), column, F.lit(tail)]
    if generation_prompt:
        parts.append(F.lit(head.format(role="assistant")))
    return F.concat(*parts)


def chat_rows(df: DataFrame, condition: str = "condition", answer: str = "answer", prompt=SYSTEM_PROMPT) -> DataFrame:
    """`full_chat` and `prefix_chat` of a plan's condition and answer; row-wise."""
    cond, out = F.array_join(condition, ""), F.array_join(answer, "")
    turns = [("system", F.lit(prompt)), ("user", cond)]
    return df.withColumns(
        {
            "full_chat": render_chat([*turns, ("assistant", out)]),
            "prefix_chat": render_chat(turns, generation_prompt=True),
        }
    )


def exchanges(turns: DataFrame, prompt=SYSTEM_PROMPT) -> DataFrame:
    """Every user turn with its dialogue so far and the assistant turn that follows it directly.

    From (conv_id, turn, role, text). `prefix_chat` holds all earlier turns of the conversation, its own
    system turn or else `prompt`; `status` is 'unanswered' where no assistant turn follows, and
    `full_chat` is null there. The dialogue so far is part of the result, so a conversation is
    gathered by its window; its turns are what one training row has to hold.
    """
    w = W.partitionBy("conv_id").orderBy("turn")
    before = w.rowsBetween(W.unboundedPreceding, 0)
    spoken = F.concat(F.lit("<|im_start|>"), "role", F.lit("\n"), "text", F.lit("<|im_end|>\n"))
    seen = turns.select(
        "conv_id", "turn", "role", F.col("text").alias("asked"),
        F.lead("turn").over(w).alias("_next"), F.lead("role").over(w).alias("_role"), F.lead("text").over(w).alias("answered"),
        F.array_join(F.collect_list(spoken).over(before), "").alias("_so_far"),
        F.max(F.col("role") == "system").over(before).alias("_system"),
    )
    head = F.when(F.col("_system"), "").otherwise(render_chat([("system", F.lit(prompt))]))
    follows = F.coalesce((F.col("_next") == F.col("turn") + 1) & (F.col("_role") == "assistant"), F.lit(False))
    both = keep_rows(seen, "role = 'user'").withColumns(
        {
            "status": F.when(follows, "answered").otherwise("unanswered"),
            "prefix_chat": F.concat(head, "_so_far", F.lit("<|im_start|>assistant\n")),
            "answered": F.when(follows, F.col("answered")),
        }
    )
    full = F.when(F.col("status") == "answered", F.concat("prefix_chat", "answered", F.lit("<|im_end|>\n")))
    return both.withColumn("full_chat", full).drop("_next", "_role", "_so_far", "_system", "role")


def training_rows(df: DataFrame, full: str = "full_ids", prefix: str = "prefix_ids", max_length: int = MAX_LENGTH) -> DataFrame:
    """`input_ids`, `labels` (prompt masked) and `attention_mask`, all cut to `max_length`."""
    cut = f"slice({full}, 1, {max_length})"
    labels = (
        f"slice(concat(array_repeat({IGNORE}, size({prefix})),"
        f" slice({cut}, size({prefix}) + 1, size({full}) + 1)), 1, {max_length})"
    )
    return df.withColumns(
        {
            "input_ids": F.expr(cut),
            "labels": F.expr(labels),
            "attention_mask": F.expr(f"array_repeat(1, least(size({full}), {max_length}))"),
        }
    )


def pad_batches(df: DataFrame, batch: str = "batch_id", pad_id: int = 0, max_length: int = 2048) -> DataFrame:
    """Right padding to the longest row of the batch, capped; the length comes from a partial aggregate."""
    longest = df.groupBy(batch).agg(F.least(F.max(F.size("input_ids")), F.lit(max_length)).alias("_len"))

    def padded(column, fill):
        return F.expr(f"concat(slice({column}, 1, _len), array_repeat({fill}, greatest(0, _len - size({column}))))")

    return (
        df.join(longest, batch)
        .withColumns(
            {
                "input_ids": padded("input_ids", pad_id),
                "labels": padded("labels", IGNORE),
                "attention_mask": padded("attention_mask", 0),
            }
        )
        .drop("_len")
    )
