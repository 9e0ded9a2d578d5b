"""Assignments against enumeration, and plans with very many rooms of one type."""

import itertools
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from planmill.operators.matching import assign, match_places, matched


def first_cheapest(wanted, answered):
    """Least total distance, then the first row of partners, by enumeration."""
    e, a = len(wanted), len(answered)
    d = [[float(np.hypot(*(np.subtract(w, o)))) for o in answered] for w in wanted]
    best = None
    for own in itertools.product(range(-1, a), repeat=e):
        used = [o for o in own if o >= 0]
        if len(used) == len(set(used)) == min(e, a):
            key = (round(sum(d[i][o] for i, o in enumerate(own) if o >= 0), 9), own)
            best = min(best or key, key)
    return [(i, o) for i, o in enumerate(best[1]) if o >= 0]


places = st.lists(st.tuples(st.integers(0, 3), st.integers(0, 2)), min_size=1, max_size=4)


@settings(max_examples=150, deadline=None)
@given(places, places)
def test_all_small_sets(wanted, answered):
    got = match_places(np.array(wanted, float), np.array(answered, float))
    assert got == first_cheapest(wanted, answered)


def test_many_rooms():
    """200 rooms: the total is that of a known assignment, and no swap of two pairs is cheaper."""
    rng = np.random.default_rng(5)
    wanted = rng.uniform(0, 1000, (200, 2))
    order = rng.permutation(200)
    assert [o for _, o in match_places(wanted, wanted[order])] == np.argsort(order).tolist()
    answered = rng.uniform(0, 1000, (230, 2))
    pairs = match_places(wanted, answered)
    assert len(pairs) == 200
    own = np.array([o for _, o in pairs])
    d = np.sqrt(((wanted[:, None] - answered[None]) ** 2).sum(axis=2))
    now = d[np.arange(200), own]
    swapped = d[:, own]
    assert (swapped + swapped.T >= now[:, None] + now[None] - 1e-6).all()
    free = np.setdiff1d(np.arange(230), own)
    assert (d[:, free] >= now[:, None] - 1e-6).all()


def test_weak_duality():
    rng = np.random.default_rng(6)
    for n in (2, 5, 6):
        cost = rng.uniform(0, 9, (n, n))
        least = min(sum(cost[i, p[i]] for i in range(n)) for p in itertools.permutations(range(n)))
        assert cost[np.arange(n), assign(cost)].sum() == pytest.approx(least)


def test_column(spark):
    rng = random.Random(2)
    place = lambda k, name: {name: k, "type": rng.choice("abc"), "cx": float(rng.randrange(9)), "cy": float(rng.randrange(9))}
    rows = [(i, [place(k, "rid") for k in range(1, rng.randrange(1, 9))], [place(k, "out") for k in range(rng.randrange(9))]) for i in range(60)]
    rows += [(90, None, []), (91, [], None), (92, [], [])]
    cell = "array<struct<{}:int,type:string,cx:double,cy:double>>"
    df = spark.createDataFrame(rows, f"i int, w {cell.format('rid')}, o {cell.format('out')}").repartition(3)
    got = {r["i"]: r["m"] for r in df.select("i", matched(F.col("w"), F.col("o")).alias("m")).collect()}
    for i, wanted, answered in rows:
        if wanted is None or answered is None:
            assert got[i] is None
            continue
        want = set()
        for t in "abc":
            w, o = ([x for x in side if x["type"] == t] for side in (wanted, answered))
            if w and o:
                pairs = first_cheapest([(x["cx"], x["cy"]) for x in w], [(x["cx"], x["cy"]) for x in o])
                want |= {(w[a]["rid"], o[b]["out"]) for a, b in pairs}
        assert {(m["rid"], m["out"]) for m in got[i]} == want
