"""Four answer sequences per plan: clean, one room moved, one room missing, one token error."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planmill.operators.answers import answer_of
from planmill.operators.tokenize import canonical_edges


def completions(plans: DataFrame, keep=()) -> DataFrame:
    """(plan_id, gen_idx, tokens) plus the `keep` columns of the plan.

    What no change reaches, the order of the edges, is made once a plan, before there are four rows of it. Tokens are made
    in Arrow batches; where only a parser reads them, it does so in the same task of Python and they never leave it.
    """
    ordered = canonical_edges(plans.select("plan_id", "rooms", "edges", "front_door", *keep)).select(
        "plan_id", "rooms", "canon_edges", "front_door",
        F.expr("cast(plan_id as long) % 2 = 0").alias("_even"),
        F.expr("1 + cast(plan_id as long) % (size(rooms) - 1)").alias("_changed"),
        *keep,
    )
    # Outer, as another one may filter what it is made from.
    four = ordered.select("*", F.explode_outer(F.expr("array(0, 1, 2, 3)")).alias("gen_idx"))
    tokens = answer_of(*(F.col(c) for c in ("gen_idx", "_even", "_changed", "rooms", "canon_edges", "front_door")))
    return four.select("plan_id", "gen_idx", tokens.alias("tokens"), *keep)
