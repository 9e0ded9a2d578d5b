"""Length statistics, mergeable sketches, and audits that do not move the source."""

import random

import pytest
from pyspark.sql import functions as F

from planmill.operators import quality
from planmill.operators import tokenize as tk
from planmill.queries import records
from planmill.sources import jsonl


@pytest.fixture(scope="module")
def sequences(spark):
    """Lengths with ties, gaps and a long tail, in 8 days."""
    rng = random.Random(1)
    rows = [(k % 8, int(rng.choice([rng.gauss(300, 40), rng.paretovariate(1.1) * 20, 500]))) for k in range(6000)]
    df = spark.createDataFrame(rows, "day int, n int").select("day", F.expr("array_repeat('x', greatest(least(n, 5000), 1))").alias("tokens"))
    return df.persist(), sorted(min(max(n, 1), 5000) for _, n in rows)


def test_exact_percentiles(sequences):
    df, lengths = sequences
    row = tk.sequence_stats(df, "tokens").first()
    for p in (50, 95, 99):
        assert row[f"p{p}_len"] == lengths[-(-len(lengths) * p // 100) - 1]
    assert (row["n"], row["min_len"], row["max_len"], row["total_len"]) == (len(lengths), lengths[0], lengths[-1], sum(lengths))
    none = tk.sequence_stats(df.limit(0), "tokens").first()
    assert none["p50_len"] is None and none["n"] is None


def test_sketches_merge_within_their_bound(sequences):
    """Ranks of quantiles from merged daily sketches are within the bound, as those of one sketch are."""
    df, lengths = sequences
    n = len(lengths)
    days = tk.length_sketches(df, "tokens", ["day"]).persist()
    assert days.count() == 8 and days.agg(F.max(F.octet_length("sketch"))).first()[0] < 8192
    probabilities = (0.01, 0.1, 0.25, 0.5, 0.75, 0.95, 0.99)
    for sketches in (tk.merged_sketches(days), tk.length_sketches(df, "tokens")):
        row = tk.sketch_quantiles(sketches, probabilities).first()
        assert row["n"] == n
        for p in probabilities:
            q = row[f"p{round(p * 100)}_len"]
            below, upto = sum(v < q for v in lengths) / n, sum(v <= q for v in lengths) / n
            assert below - 0.014 <= p <= upto + 0.014


def test_audit_of_a_sample(spark):
    """Each fault turns exactly its own flag, and the lines of other plans are neither shuffled nor parsed."""
    plan = '{{"plan_id":{0},"rooms":[{{"rid":0,"type":"outline","coords":[0,0,0,9,9,9,9,0]}},{{"rid":1,"type":"kitchen","coords":[1,1,1,2,2,2]}}],"edges":[{{"pair":[1,2],"doors":[]}}],"front_door":{1},"spatial":[[1,2,"right"]]}}'
    lines = spark.createDataFrame([(plan.format(k, "null" if k % 2 else '{"x":1,"y":2,"w":3,"h":4}'),) for k in range(40)], "value string")
    good, bad = jsonl.ingest(lines)
    assert bad.count() == 0
    changes = {
        "1": ("rooms", "transform(rooms, r -> named_struct('rid', r.rid, 'type', 'x', 'coords', r.coords))", "same_types"),
        "2": ("rooms", "transform(rooms, r -> named_struct('rid', r.rid, 'type', r.type, 'coords', reverse(r.coords)))", "same_coords"),
        "3": ("edges", "transform(edges, e -> named_struct('pair', reverse(e.pair), 'door', e.door))", "same_pairs"),
        "4": ("front_door", "slice(front_door, 1, 0)", "same_front"),
        "5": ("front_door", "array(named_struct('x', 1F, 'y', 1F, 'w', 1F, 'h', 1F))", "same_front"),
        "6": ("spatial", "slice(spatial, 1, 0)", "same_spatial_count"),
    }
    for plan_id, (column, change, _) in changes.items():
        good = good.withColumn(column, F.expr(f"if(plan_id = '{plan_id}', {change}, {column})"))
    some = lines.filter("not value like '%:7,\"rooms%'")
    flags = ["found", "same_room_count", "same_types", "same_coords", "same_pairs", "same_front", "same_spatial_count"]
    for k in (None, 40):
        got = {r["plan_id"]: [f for f in flags if not r[f]] for r in quality.audit_lines(good, some, k).collect()}
        want = {str(i): [] for i in range(40)} | {p: [c[2]] for p, c in changes.items()} | {"7": flags}
        assert got == want
    assert quality.audit_lines(good, some, 10).count() == 10
    plan_text = quality.audit_lines(*records.spoiled(spark, "/root/testdata/sf0.001"), k=5)._jdf.queryExecution().executedPlan().toString()
    semi = plan_text[plan_text.index("LeftSemi") :]
    assert "BroadcastHashJoin" in plan_text and "SortMergeJoin" not in semi.split("Scan", 1)[0]
