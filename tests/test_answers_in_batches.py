"""Answers made, read and scored in Arrow batches: against the regular expressions and against the column expressions they replace."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from planmill.operators import strict, tolerant
from planmill.operators import tokenize as tk
from planmill.operators.answers import answer_of
from planmill.operators.facts import facts
from planmill.queries import parsing, scoring

SF = "/root/testdata/sf0.001"
WORD = {
    "R": "<ROOM>", "r": "<END_ROOM>", "D": "<DOOR>", "d": "<END_DOOR>", "s": "<SEP_DOOR>", "n": "<NO_DOOR>", "F": "<FRONT_DOOR>",
    "O": "<OUTPUT>", "E": "<END_OUTPUT>", "e": "<EOS>", "t": "<TYPE:a>", "x": "<X:3>", "y": "<Y:4>", "?": "other",
}


def _letters(rnd):
    text = "O" + rnd.choice(["", "Fnd", "Fxysxyd", "Fn", "Fyxsxyd"]) + "".join("Rt" + "xy" * rnd.randrange(6) + "r" for _ in range(rnd.randrange(4)))
    text += "".join(rnd.choice(["Dxysxyd", "n"]) for _ in range(rnd.randrange(4))) + rnd.choice(["E", "", "e", "ER", "Ern"])
    for _ in range(rnd.choice([0, 0, 1, 3])):
        i = rnd.randrange(len(text) + 1)
        text = rnd.choice([text[:i] + text[i + 1 :], text[:i] + rnd.choice(list(WORD)) + text[i:]])
    return text


@pytest.mark.parametrize("reader", [strict, tolerant])
def test_plain_lines_are_read_as_by_expressions(reader, monkeypatch):
    rnd = random.Random(5)
    lists = [None, [], *([WORD[c] for c in _letters(rnd)] for _ in range(1500))]
    rows = pa.array(lists, pa.list_(pa.string()))
    plain = reader._plain(strict.Tokens(rows))[0]
    assert 300 < plain.sum() < 1300
    got = reader._read(rows).to_pylist()
    nothing = np.zeros((3, 0), np.int64)
    found = (nothing,) * 3 if reader is strict else ({"F": nothing, "R": nothing, "D": nothing},)
    monkeypatch.setattr(reader, "_plain", lambda tokens: (np.zeros(len(rows), bool), *found))
    assert got == reader._read(rows).to_pylist()


def test_answers_are_those_of_the_expression(spark):
    rnd = random.Random(6)
    some = lambda v: None if rnd.random() < 0.1 else v
    door = lambda: tuple(some(rnd.choice([0.5, 1.5, 2.5, -3.2, 70000.0])) for _ in range(4))
    rows = []
    for k in range(300):
        rooms = [
            some((some(rnd.randrange(5)), some(rnd.choice(["outline", "bedroom", "kitchen"])), [some(rnd.randrange(-9, 300)) for _ in range(rnd.choice([0, 3, 8, 8]))]))
            for _ in range(rnd.randrange(6))
        ]
        edges = [([1, 2], [some(door()) for _ in range(rnd.randrange(3))]) for _ in range(rnd.randrange(3))]
        rows.append((k, some(rooms), some(edges), some([door() for _ in range(rnd.randrange(3))])))
    kind = (
        "k int, rooms array<struct<rid:int,type:string,coords:array<int>>>, edges array<struct<pair:array<int>,"
        "door:array<struct<x:double,y:double,w:double,h:double>>>>, front_door array<struct<x:double,y:double,w:double,h:double>>"
    )
    df = tk.answer_tokens(spark.createDataFrame(rows, kind).coalesce(1))
    made = answer_of(F.lit(0), F.lit(True), F.lit(1), F.col("rooms"), F.col("edges"), F.col("front_door"))
    for r in df.select("answer", made.alias("got")).collect():
        assert r["got"] == r["answer"]


def test_answers_stay_in_python_until_they_are_read(spark):
    """The strict reading takes the tokens from the function that makes them; scores take all facts in one step after it."""
    steps = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython")
    assert steps(parsing.parse_strict(spark, SF)) == 1
    assert steps(parsing.parse_answer(spark, SF)) == 1
    assert steps(scoring.score_all(spark, SF)) == 2
    assert steps(scoring.room_matching(spark, SF)) == 2


def test_connections_and_type_counts_are_those_of_the_expressions(spark):
    rnd = random.Random(7)
    types = ["bedroom", "kitchen", "bathroom", "outline"]
    rows = []
    for k in range(300):
        wanted = [(rnd.choice([1, 2, 3, None]) if rnd.random() < 0.3 else i, rnd.choice([*types, None]), [rnd.randrange(60) for _ in range(8)]) for i in range(rnd.randrange(5))]
        rooms = []
        for i in range(rnd.randrange(5)):
            x, y = rnd.randrange(50), rnd.randrange(50)
            rooms.append((rnd.choice(types), [(x, y), (x, y + 9), (x + 9, y + 9), (x + 9, y)], [3, 5, 7, 9], 0, 12))
        doors = [((rnd.randrange(60), rnd.randrange(60), 2, 2) if rnd.random() < 0.9 else None,) for _ in range(rnd.randrange(4))]
        edges = [(rnd.choice([[1, 2], [0, 1], [2, 3], [1], None, [None, 2]]), rnd.choice([[], [(1.0,)], None])) for _ in range(rnd.randrange(4))]
        counts = {t: rnd.randrange(4) for t in types if rnd.random() < 0.5}
        rows.append((k, rooms, doors, wanted, edges if rnd.random() < 0.9 else None, counts if rnd.random() < 0.9 else None))
    kind = (
        "k int, rooms array<struct<type:string,points:array<struct<x:int,y:int>>,idx:array<int>,block_start:int,block_end:int>>,"
        "doors array<struct<door:struct<x:int,y:int,w:int,h:int>>>, wanted array<struct<rid:int,type:string,coords:array<int>>>,"
        "edges array<struct<pair:array<int>,door:array<struct<x:double>>>>, counts map<string,int>"
    )
    made = facts(["outs", "types", "match", "reach", "connected"], **{c: F.col(c) for c in ("rooms", "doors", "wanted", "edges")}, counts=F.expr("map_entries(counts)"))
    df = spark.createDataFrame(rows, kind).coalesce(1).withColumn("s", made)
    out = "filter(rooms, r -> r.type <> 'outline')"
    ends = lambda i: f"get(filter(s.match, z -> z.rid = get(e.pair, {i})), 0).out"
    doored = "filter(edges, e -> size(e.door) > 0)"
    share = (
        f"size(filter({doored}, e -> size(e.pair) >= 2 and {ends(0)} is not null and {ends(1)} is not null and"
        f" exists(s.near, n -> array_contains(n, {ends(0)}) and array_contains(n, {ends(1)})))) / cast(size({doored}) as double)"
    )
    got = f"size(filter({out}, r -> r.type = t))"
    listed = f"transform(map_keys(counts), t -> greatest(0D, 1D - abs({got} - counts[t]) / cast(greatest(counts[t], 1) as double)))"
    rows = df.select(
        F.expr(f"size({out})").alias("n"), "s",
        F.expr(f"case when size(edges) = 0 then 1D when size(s.match) = 0 then 0D when size({doored}) = 0 then 1D else {share} end").alias("connected"),
        F.expr(
            f"if(size(counts) = 0, 1D, aggregate({listed}, 0D, (a, v) -> a + v) / (size(counts) +"
            f" size(array_except(transform({out}, r -> r.type), map_keys(counts)))))"
        ).alias("types"),
    ).collect()
    for r in rows:
        assert r["s"]["n_out"] == r["n"]
        assert r["s"]["connected"] == pytest.approx(r["connected"])
        assert r["s"]["type_share"] == pytest.approx(r["types"])
