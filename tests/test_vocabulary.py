"""Encoding with numbers of several ids, and places carried there and back."""

import random

from pyspark.sql import functions as F

from planmill.operators import vocabulary as v


def test_places_there_and_back(spark):
    rng = random.Random(7)
    vocab = spark.createDataFrame([("<X:3>", 50), ("<TOTAL>", 51), ("<COUNT>", 52)], "token string, id int")
    numbers = spark.createDataFrame([(n, [int(d) for d in str(n)]) for n in range(120)], "n int, ids array<int>")
    codec = v.Codec(vocab, numbers)
    ids = {"<X:3>": [50], "<TOTAL>": [51], "<COUNT>": [52], **{str(n): [int(d) for d in str(n)] for n in range(120)}}
    rows = []
    for k in range(40):
        tokens = [rng.choice(["<X:3>", "<TOTAL>", "<COUNT>", "<odd>", str(rng.randrange(120))]) for _ in range(rng.randrange(9))]
        rows.append((k, tokens, [rng.randrange(-2, 11) for _ in range(4)]))
    df = codec.with_encoded(spark.createDataFrame(rows, "k int, tokens array<string>, marks array<int>"), "tokens")
    df = df.withColumn("at", F.expr(v.places_of_tokens("marks"))).withColumn("back", F.expr(v.tokens_of_places("concat(at, array(-1, 999))")))
    got = {r["k"]: r for r in df.withColumn("plain", codec.encode("tokens")).collect()}
    for k, tokens, marks in rows:
        parts = [ids.get(t, [None]) for t in tokens]
        flat = [i for p in parts for i in p]
        owner = [n for n, p in enumerate(parts) for _ in p]
        marked = sorted({m for m in marks if 0 <= m < len(tokens)})
        r = got[k]
        assert (r["ids"], r["token_of"], r["plain"]) == (flat, owner, flat)
        assert r["first_of"] == [owner.index(n) for n in range(len(tokens))]
        assert r["at"] == [p for p, n in enumerate(owner) if n in marked] and r["back"] == marked
    good, bad = v.split_unknown(df, "ids")
    assert {r["k"] for r in bad.collect()} == {k for k, tokens, _ in rows if "<odd>" in tokens}
    assert good.count() + bad.count() == len(rows)


def test_encoding_looks_at_a_token_once_a_batch(spark):
    """It went through the whole vocabulary for every token of every row; no such list is in the plan any more."""
    vocab = v.token_table(spark).selectExpr("token", "ord as id")
    codec = v.Codec(vocab, spark.createDataFrame([(7, [900, 901]), (8, [])], "n int, ids array<int>"))
    rows = [(0, ["<X:5>", "7", "<X: 5 >", "8", "<X:999>", "nothing", None, "<RID:3>", "<PAD>"]), (1, None), (2, [])]
    df = spark.createDataFrame(rows, "k int, tokens array<string>")
    made = codec.with_encoded(df, "tokens")
    assert "<REL:" not in made._jdf.queryExecution().optimizedPlan().toString()
    got = {r["k"]: r for r in made.withColumn("plain", codec.encode("tokens")).collect()}
    x, rid, pad = codec.ids["<X:5>"], codec.ids["<RID:3>"], codec.ids.get("<PAD>")
    assert got[0]["ids"] == got[0]["plain"] == [x, 900, 901, x, None, None, None, rid, pad]
    assert got[0]["token_of"] == [0, 1, 1, 2, 4, 5, 6, 7, 8] and got[0]["first_of"] == [0, 1, 3, 4, 4, 5, 6, 7, 8]
    assert got[1]["ids"] is None and got[2]["ids"] == []
