"""Parsing, scoring and advantages on hand-made and random sequences."""

import random

import pytest
from pyspark.sql import functions as F

from planmill.operators import advantage, parse, score

BOX = lambda t, x, y, w, h: (
    f"<ROOM> <TYPE:{t}> <X:{x}> <Y:{y}> <X:{x}> <Y:{y + h}> <X:{x + w}> <Y:{y + h}> <X:{x + w}> <Y:{y}> <END_ROOM>"
)
CLEAN = f"<OUTPUT> <FRONT_DOOR> <NO_DOOR> <END_DOOR> {BOX('outline', 0, 0, 100, 100)} {BOX('bedroom', 10, 10, 40, 40)} <END_OUTPUT>"
META = (
    "named_struct('total_rooms', {n}, 'type_counts', map('bedroom', 1), 'edges', cast(array() as array<struct<pair:array<int>,door:array<struct<x:double,y:double,w:double,h:double>>>>),"
    " 'spatial', cast(array() as array<struct<rid_a:int,rid_b:int,direction:string>>), 'rooms', cast(array() as array<struct<rid:int,type:string,coords:array<int>>>))"
)


def frame(spark, texts):
    rows = [(i, t.split(" ") if t else []) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "id int, tokens array<string>")


def scores(spark, texts, n=1):
    df = parse.parse_strict(frame(spark, texts)).withColumn("meta", F.expr(META.format(n=n)))
    return {r["id"]: r for r in score.score(df).collect()}


def test_clean_and_broken(spark):
    missing_x = CLEAN.replace("<X:10> <Y:50>", "<Y:50>", 1)
    got = scores(spark, [CLEAN, missing_x, "<OUTPUT> <END_OUTPUT>", "<END_OUTPUT>"])
    assert got[0]["parsed"]["level"] == 3 and got[0]["parsed"]["errors"] == []
    assert [got[0][f"r_{n}"] for n in score.REWARDS[:5]] == [1.0] * 5
    assert got[1]["parsed"]["level"] == 2 and got[1]["r_format"] == 0.0 and len(got[1]["parsed"]["errors"]) > 0
    assert got[2]["parsed"]["level"] == 1 and got[3]["parsed"]["level"] == 0
    assert got[3]["parsed"]["errors"] == [0]
    assert scores(spark, [CLEAN], n=3)[0]["r_count_total"] == 0.0


def walk(tokens):
    """Slow step-by-step reading of the answer grammar: (level, error set, rooms, doors)."""
    n, err, rooms, doors = len(tokens), set(), [], 0
    if "<OUTPUT>" not in tokens:
        return 0, set(range(n)), [], 0
    i = tokens.index("<OUTPUT>") + 1
    is_x = lambda k: k < n and tokens[k].startswith("<X:")
    is_y = lambda k: k < n and tokens[k].startswith("<Y:")
    at = lambda k, t: k < n and tokens[k] == t

    def door(k):
        seen = 0
        for part in (is_x, is_y, "<SEP_DOOR>", is_x, is_y, "<END_DOOR>"):
            hit = at(k, part) if isinstance(part, str) else part(k)
            if hit:
                k += 1
                seen += not isinstance(part, str)
            elif isinstance(part, str):
                err.add(k)
        return k, seen == 4

    if at(i, "<FRONT_DOOR>"):
        i += 1
        if at(i, "<NO_DOOR>"):
            i += 1
            i += at(i, "<END_DOOR>")
        else:
            i, _ = door(i)
    stops = {"<ROOM>", "<END_ROOM>", "<DOOR>", "<END_DOOR>", "<NO_DOOR>", "<END_OUTPUT>", "<FRONT_DOOR>"}
    while at(i, "<ROOM>"):
        start = i
        i += 1
        if not (i < n and tokens[i].startswith("<TYPE:")):
            err.add(start)
            while i < n and tokens[i] != "<END_ROOM>":
                i += 1
            i += i < n
            continue
        i += 1
        pts = []
        while i < n and tokens[i] not in stops:
            if is_x(i) and is_y(i + 1):
                pts.append(i)
                i += 2
            else:
                err.add(i)
                i += 1
        if at(i, "<END_ROOM>"):
            i += 1
        else:
            err.add(i)
        if len(pts) < 4:
            err |= set(range(start, i))
        rooms.append(pts)
    while i < n and tokens[i] not in ("<END_OUTPUT>", "<EOS>"):
        if at(i, "<DOOR>"):
            i, ok = door(i + 1)
            doors += ok
        else:
            if tokens[i] != "<NO_DOOR>":
                err.add(i)
            i += 1
    return (1 if not rooms else 2 if err else 3), err, rooms, doors


def test_strict_parser_matches_slow_walk(spark):
    rng = random.Random(7)
    words = ["<OUTPUT>", "<ROOM>", "<END_ROOM>", "<DOOR>", "<END_DOOR>", "<SEP_DOOR>", "<NO_DOOR>", "<FRONT_DOOR>",
             "<END_OUTPUT>", "<EOS>", "<TYPE:kitchen>", "<X:1>", "<Y:2>", "7", "<EDGE>", "<RID:3>"]
    texts = [CLEAN, ""]
    for _ in range(400):
        tokens = CLEAN.split(" ") + "<DOOR> <X:1> <Y:2> <SEP_DOOR> <X:3> <Y:4> <END_DOOR>".split(" ")
        if rng.random() < 0.5:
            for _ in range(rng.randint(1, 4)):
                k = rng.randrange(len(tokens))
                tokens[k:k + rng.randint(0, 2)] = [rng.choice(words)] * rng.randint(0, 2)
        else:
            tokens = ["<OUTPUT>"] * (rng.random() < 0.9) + rng.choices(words, k=rng.randint(0, 40))
        texts.append(" ".join(tokens))
    got = parse.parse_strict(frame(spark, texts)).select("id", "parsed").collect()
    for r in got:
        level, err, rooms, doors = walk(texts[r["id"]].split(" ") if texts[r["id"]] else [])
        p = r["parsed"]
        assert p["level"] == level, texts[r["id"]]
        assert p["errors"] == sorted(err), texts[r["id"]]
        assert [x["idx"] for x in p["rooms"]] == rooms
        assert sum(d["door"] is not None for d in p["doors"]) == doors


def test_overlap_against_cell_count(spark):
    rng = random.Random(3)
    texts, want = [], []
    for _ in range(60):
        boxes = [(rng.randint(0, 30), rng.randint(0, 30), rng.randint(4, 20), rng.randint(4, 20)) for _ in range(3)]
        rooms = " ".join(BOX("bedroom", *b) for b in boxes)
        texts.append(f"<OUTPUT> {BOX('outline', 0, 0, 90, 90)} {rooms} <END_OUTPUT>")
        cells = [{(x + i, y + j) for i in range(w) for j in range(h)} for x, y, w, h in boxes]
        common = sum(len(cells[a] & cells[b]) for a in range(3) for b in range(a + 1, 3))
        want.append(1 - min(1.0, common / sum(map(len, cells))))
    got = scores(spark, texts)
    for i, w in enumerate(want):
        assert got[i]["r_no_overlap"] == pytest.approx(w, abs=1e-9)
        assert (len(got[i]["e_no_overlap"]) > 0) == (w < 1)


def test_overlap_of_slanted_rooms(spark):
    ring = lambda pts: "<ROOM> <TYPE:bedroom> " + " ".join(f"<X:{x}> <Y:{y}>" for x, y in pts) + " <END_ROOM>"
    diamond = ring([(10, 0), (20, 10), (10, 20), (0, 10)])
    text = f"<OUTPUT> {BOX('outline', 0, 0, 90, 90)} {diamond} {BOX('bedroom', 10, 0, 10, 20)} <END_OUTPUT>"
    crossed = ring([(0, 0), (10, 10), (10, 0), (0, 10)])
    bow = f"<OUTPUT> {BOX('outline', 0, 0, 90, 90)} {crossed} {BOX('bedroom', 0, 0, 10, 10)} <END_OUTPUT>"
    got = scores(spark, [text, bow])
    assert got[0]["r_no_overlap"] == pytest.approx(1 - 100 / 400)
    assert got[1]["r_no_overlap"] == 1.0
    assert got[0]["r_orthogonality"] == 1.0
    assert got[1]["r_orthogonality"] < 1.0


def test_overlap_marks_nearest_vertices(spark):
    text = f"<OUTPUT> {BOX('outline', 0, 0, 90, 90)} {BOX('bedroom', 0, 0, 10, 10)} {BOX('bedroom', 8, 8, 10, 10)} <END_OUTPUT>"
    r = scores(spark, [text])[0]
    first, second = r["parsed"]["rooms"][1], r["parsed"]["rooms"][2]
    corner_a = first["idx"][2]
    corner_b = second["idx"][0]
    assert {corner_a, corner_a + 1, corner_b, corner_b + 1} <= set(r["e_no_overlap"])


def test_group_normalisation_and_credit(spark):
    rows = [(1, g, float(a), 1.0) for g, a in enumerate([0, 1, 2, 3])] + [(2, g, 4.0, 1.0) for g in range(4)]
    df = spark.createDataFrame(rows, "prompt_id int, gen_idx int, r_format double, r_spatial double")
    got = advantage.group_normalize(df).collect()
    assert all(abs(r["a_format"]) < 1e-9 for r in got if r["prompt_id"] == 2)
    assert abs(sum(r["a_format"] for r in got if r["prompt_id"] == 1)) < 1e-9
    one = spark.range(1).select(
        F.expr(advantage.credit("2.0D", score.error_mask("5", "array(2, 9)"), 1.5)).alias("p"),
        F.expr(advantage.credit("-1.5D", score.error_mask("5", "array(1)"), 2.0)).alias("n"),
    ).first()
    assert list(one["p"]) == [2.0, 2.0, -3.0, 2.0, 2.0] and one["n"][1] == -3.0


def test_every_part_of_an_overlap_is_marked(spark):
    """A comb over a bar: two parts, each marked; a line shared elsewhere is not."""
    ring = lambda pts: "<ROOM> <TYPE:bedroom> " + " ".join(f"<X:{x}> <Y:{y}>" for x, y in pts) + " <END_ROOM>"
    comb = ring([(0, 0), (0, 20), (4, 20), (4, 10), (16, 10), (16, 20), (20, 20), (20, 0)])
    bar = ring([(0, 18), (0, 30), (20, 30), (20, 18)])
    # The bar's upper side runs along the notch of `step`, and the two meet in one corner area only.
    step = ring([(30, 0), (30, 12), (50, 12), (50, 10), (40, 10), (40, 0)])
    flat = ring([(35, 10), (35, 14), (60, 14), (60, 10)])
    text = f"<OUTPUT> {BOX('outline', 0, 0, 90, 90)} {comb} {bar} <END_OUTPUT>"
    touch = f"<OUTPUT> {BOX('outline', 0, 0, 90, 90)} {step} {flat} <END_OUTPUT>"
    got = scores(spark, [text, touch])
    first, second = got[0]["parsed"]["rooms"][1], got[0]["parsed"]["rooms"][2]
    marks = {i for i in got[0]["e_no_overlap"]}
    assert got[0]["r_no_overlap"] == pytest.approx(1 - 16 / (280 + 240))
    assert {first["idx"][k] for k in (1, 2, 5, 6)} <= marks and not {first["idx"][k] for k in (3, 4, 0, 7)} & marks
    assert {second["idx"][k] for k in (0, 3)} <= marks and not {second["idx"][k] for k in (1, 2)} & marks
    step_, flat_ = got[1]["parsed"]["rooms"][1], got[1]["parsed"]["rooms"][2]
    marks = set(got[1]["e_no_overlap"])
    # Common area: 35..50 by 10..12; the corner (60, 10) of `flat` lies on no common area.
    assert {step_["idx"][2], step_["idx"][3], flat_["idx"][0]} <= marks and step_["idx"][0] not in marks


def test_tokens_are_classified_as_spark_casts_them(spark):
    from planmill.operators import strict

    texts = ["1", "-7", "+3", " 12 ", "1.5", "", "-", "2147483647", "2147483648", "1e2", "\t4", "1 2", "٣", "0x1", "00"]
    cast = spark.createDataFrame([(t,) for t in texts], "t string").selectExpr("t", "try_cast(t as int) as v").collect()
    assert {r["t"]: r["v"] for r in cast} == {t: strict.number(t) for t in texts}
    assert [strict.classify(t)[0] for t in ("<X:5>", "<Y:5>", "<X:a>", "<X:", "<TYPE:x>", "<RID:1>", "<ROOM>", "x", None)] == list("xy??tiR??")


def test_a_missing_sequence_is_no_answer(spark):
    """A null list had level 3, that of an answer without errors."""
    rows = [(0, CLEAN.split(" ")), (1, None), (2, []), (3, ["<OUTPUT>", None, "<ROOM>"])]
    got = {r["id"]: r["parsed"] for r in parse.parse_strict(spark.createDataFrame(rows, "id int, tokens array<string>")).collect()}
    assert got[0]["level"] == 3 and got[1] is None and got[2]["level"] == 0 and got[2]["errors"] == []
    assert got[3]["level"] == 1 and got[3]["errors"] == [1, 2]


def test_overlap_of_random_boxes_against_cells(spark):
    """Common areas, counted cell by cell; a room outside any int product had ended the job by an overflow."""
    rng = random.Random(5)
    texts, want = [], []
    for _ in range(60):
        boxes = [(rng.randint(0, 12), rng.randint(0, 12), rng.randint(1, 9), rng.randint(1, 9)) for _ in range(rng.randint(2, 6))]
        cells = [{(i, j) for i in range(x, x + w) for j in range(y, y + h)} for x, y, w, h in boxes]
        common = sum(len(a & b) for k, a in enumerate(cells) for b in cells[:k])
        want.append(1 - min(common / sum(map(len, cells)), 1))
        texts.append(f"<OUTPUT> {BOX('outline', 0, 0, 30, 30)} " + " ".join(BOX("bedroom", *b) for b in boxes) + " <END_OUTPUT>")
    far = 2_000_000_000
    slanted = f"<ROOM> <TYPE:bedroom> <X:0> <Y:-{far}> <X:{far}> <Y:0> <X:0> <Y:{far}> <X:-{far}> <Y:0> <END_ROOM>"
    texts.append(f"<OUTPUT> {BOX('outline', 0, 0, 30, 30)} {slanted} {BOX('bedroom', 0, -far, far, 2 * far - 1)} <END_OUTPUT>")
    got = scores(spark, texts)
    assert [got[i]["r_no_overlap"] for i in range(60)] == pytest.approx(want, abs=1e-9)
    assert got[60]["r_no_overlap"] == pytest.approx(1 - far**2 / (2 * far**2 + far * (2 * far)), abs=1e-6)


def test_areas_of_several_parts_are_left_unmarked_on_request(spark):
    ring = lambda pts: "<ROOM> <TYPE:bedroom> " + " ".join(f"<X:{x}> <Y:{y}>" for x, y in pts) + " <END_ROOM>"
    comb = ring([(0, 0), (0, 20), (4, 20), (4, 10), (16, 10), (16, 20), (20, 20), (20, 0)])
    bar = ring([(0, 18), (0, 30), (20, 30), (20, 18)])
    low = ring([(0, 8), (0, 30), (20, 30), (20, 8)])
    texts = [f"<OUTPUT> {BOX('outline', 0, 0, 90, 90)} {comb} {other} <END_OUTPUT>" for other in (bar, low)]
    df = parse.parse_strict(frame(spark, texts)).withColumn("_gate", F.lit(True))
    for every_part, marked in ((True, {0, 1}), (False, {1})):
        rows = score.with_shapes(df, ["marks"], every_part).select("id", "_shape.marks").collect()
        assert {r["id"] for r in rows if r["marks"]} == marked


def test_doors_in_reach_against_single_steps(spark):
    rng = random.Random(8)
    texts, want = [], []
    for _ in range(40):
        boxes = [(rng.randint(0, 60), rng.randint(0, 60), rng.randint(5, 60), rng.randint(5, 60)) for _ in range(3)]
        doors = [(rng.randint(0, 120), rng.randint(0, 120)) for _ in range(rng.randint(0, 3))]
        near = []
        for px, py in doors:
            gap = []
            for x, y, w, h in boxes:
                cx, cy = min(max(px, x), x + w), min(max(py, y), y + h)
                inside = min(px - x, x + w - px, py - y, y + h - py)
                gap.append(inside if inside >= 0 else ((px - cx) ** 2 + (py - cy) ** 2) ** 0.5)
            near.append([o for o, g in enumerate(gap) if g <= 20])
        want.append(near)
        parts = [BOX("outline", 0, 0, 120, 120), *[BOX("bedroom", *b) for b in boxes]]
        parts += [f"<DOOR> <X:{x}> <Y:{y}> <SEP_DOOR> <X:4> <Y:2> <END_DOOR>" for x, y in doors]
        texts.append(f"<OUTPUT> {' '.join(parts)} <END_OUTPUT>")
    df = parse.parse_strict(frame(spark, texts)).withColumn("_gate", F.lit(True))
    got = {r["id"]: r["near"] for r in score.with_shapes(df, ["reach"]).select("id", "_shape.near").collect()}
    assert [got[i] for i in range(40)] == want


def test_completions_against_answers_of_changed_plans(spark):
    """A moved room may change its place; what the four share was made four times."""
    from planmill.operators import tokenize as tk
    from planmill.sources.completions import completions

    ring = lambda x, y: [x, y, x, y + 10, x + 10, y + 10, x + 10, y]
    rooms = [(0, "outline", ring(0, 0)), (1, "bedroom", ring(0, 5)), (2, "kitchen", ring(10, 5)), (3, "bathroom", ring(5, 0))]
    door = [(1.0, 2.0, 3.0, 4.0)]
    kind = (
        "plan_id string, rooms array<struct<rid:int,type:string,coords:array<int>>>, edges array<struct<pair:array<int>,"
        "door:array<struct<x:double,y:double,w:double,h:double>>>>, front_door array<struct<x:double,y:double,w:double,h:double>>"
    )
    plans = [(str(k), rooms, [([2, 1], door), ([1, 3], [])], door if k else []) for k in range(4)]
    shift = lambda c: [v + 20 if i % 2 == 0 else v for i, v in enumerate(c)]
    changed = []
    for k, own, edges, front in plans:
        moved = [(r, t, shift(c) if r == 1 + int(k) % 3 else c) for r, t, c in own]
        changed += [(f"{k}/{g}", rs, edges, front) for g, rs in enumerate((own, moved, own[:3]))]
    want = {r["plan_id"]: r["answer"] for r in tk.answer_tokens(spark.createDataFrame(changed, kind)).collect()}
    for k, *_ in plans:
        whole = want[f"{k}/0"]
        if int(k) % 2 == 0:
            at = whole.index("<END_ROOM>")
            want[f"{k}/3"] = whole[:at] + whole[at + 1 :]
        else:
            at = next(i for i, t in enumerate(whole) if t.startswith("<X:"))
            want[f"{k}/3"] = whole[:at] + [whole[at + 1], whole[at]] + whole[at + 2 :]
    made = completions(spark.createDataFrame(plans, kind))
    assert {f"{r['plan_id']}/{r['gen_idx']}": r["tokens"] for r in made.collect()} == want
    # Rooms are put in order below the step that makes four rows of a plan.
    below = made._jdf.queryExecution().optimizedPlan().toString().split("Generate ")[1]
    assert "array_sort(" in below and "Filter" not in below


def test_statistics_of_scores_do_not_read_error_places(spark):
    """Scores are kept in columns: a checkpoint is read whole, with all token places."""
    from planmill.queries.scoring import group_normalize

    plan = group_normalize(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "r_format" in plan and "LogicalRDD" not in plan
