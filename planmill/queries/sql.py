"""Building blocks of the reference SQL (DuckDB dialect) that the checks run beside Spark."""

import re

from planmill.constants import DIRECTIONS, MAX_RID, OUTLINE, ROOM_TYPES


def names(values):
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def u(op, item="''", seed=42, variant="variant", plan="plan_id"):
    return (
        f"(('0x' || substr(md5(concat_ws('|', {seed}, {variant}, {plan}, '{op}', {item})), 1, 8))::BIGINT::DOUBLE"
        f" / 4294967296::DOUBLE)"
    )


def xs(c):
    return f"list_filter({c}, lambda v, i: i % 2 = 1)"


def ys(c):
    return f"list_filter({c}, lambda v, i: i % 2 = 0)"


def mean(values):
    return f"(list_sum({values})::DOUBLE / len({values})::DOUBLE)"


def built(dx, dy):
    angle = f"degrees(atan2({dy}, {dx}))"
    cases = []
    for k, name in enumerate(DIRECTIONS):
        mid = 45.0 * k if k <= 4 else 45.0 * k - 360.0
        if name != "left":
            cases.append(f"WHEN {angle} > {mid - 22.5} AND {angle} <= {mid + 22.5} THEN '{name}'")
    return f"CASE {' '.join(cases)} ELSE 'left' END"


def scored(dx, dy):
    angle = f"degrees(atan2({dy}, {dx}))"
    cases = []
    for k, name in enumerate(DIRECTIONS):
        mid = 45.0 * k if k <= 4 else 45.0 * k - 360.0
        if name != "left":
            cases.append(f"WHEN {angle} >= {mid - 22.5} AND {angle} < {mid + 22.5} THEN '{name}'")
    return f"CASE WHEN abs({dx}) < 1e-9 AND abs({dy}) < 1e-9 THEN NULL {' '.join(cases)} ELSE 'left' END"


def swap(text, a, b):
    return f"replace(replace(replace({text}, '{a}', '#'), '{b}', '{a}'), '#', '{b}')"


def tok(kind, value):
    return f"('<{kind}:' || ({value})::VARCHAR || '>')"


def coord_text(coords):
    """Coordinate tokens of a list, separated by blanks."""
    return (
        f"array_to_string(list_transform({coords}, lambda v, i:"
        f" (CASE WHEN i % 2 = 1 THEN '<X:' ELSE '<Y:' END) || v::VARCHAR || '>'), ' ')"
    )


def ri(value):
    return f"round_even(({value})::DOUBLE, 0)::INTEGER"


def door_text(x, y, w, h):
    return (
        f"'<X:' || {ri(x)} || '> <Y:' || {ri(y)} || '> <SEP_DOOR> <X:' || {ri(w)} || '> <Y:' || {ri(h)} || '>'"
    )


CTES = {
    "sized": f"SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING count(*) <= {MAX_RID}",
    "item": """
        SELECT l_orderkey AS ok, l_partkey AS pk, l_suppkey AS sk, l_quantity::INTEGER AS qty, l_linenumber AS ln,
               row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity)::INTEGER AS rid
        FROM lineitem WHERE l_orderkey IN (SELECT l_orderkey FROM sized)""",
    "corner": f"""
        SELECT ok, rid, pk, ln, {names(ROOM_TYPES)}[pk % 8 + 1] AS type,
               (48 * ((rid - 1) % 4) + pk % 16)::INTEGER AS x0, (48 * ((rid - 1) // 4) + sk % 16)::INTEGER AS y0,
               (24 + qty % 40)::INTEGER AS w, (24 + (pk + sk) % 40)::INTEGER AS h FROM item""",
    "box": """
        SELECT ok, ok::VARCHAR AS plan_id, rid, pk, type, x0, y0, x0 + w AS x1, y0 + h AS y1,
               x0 + w // 2 AS xm, y0 + h // 2 AS ym, ln % 2 = 0 AS ell FROM corner""",
    "outl": """
        SELECT plan_id, ok, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1, count(*)::INTEGER AS n
        FROM box GROUP BY ALL""",
    "room0": f"""
        SELECT plan_id, 1 AS variant, 0 AS pos, 0 AS rid, '{OUTLINE}' AS type,
               [x0, y0, x0, y1, x1, y1, x1, y0] AS coords FROM outl
        UNION ALL
        SELECT plan_id, 1, rid, rid, type, CASE WHEN ell THEN [x0, y0, x0, y1, x1, y1, x1, ym, xm, ym, xm, y0]
               ELSE [x0, y0, x0, y1, x1, y1, x1, y0] END FROM box""",
    "pairing": """
        SELECT a.plan_id, a.rid AS a, b.rid AS b, (a.pk + b.pk) % 3 <> 0 AS hd,
               (a.x0 + a.x1 + b.x0 + b.x1) / 4.0 AS x, (a.y0 + a.y1 + b.y0 + b.y1) / 4.0 AS y,
               2 + a.pk % 6 AS w, 2 + b.pk % 6 AS h
        FROM box a JOIN box b ON a.plan_id = b.plan_id
         AND ((b.rid = a.rid + 1 AND a.rid % 4 <> 0) OR b.rid = a.rid + 4)""",
    "edge0": """
        SELECT plan_id, 1 AS variant, (row_number() OVER (PARTITION BY plan_id ORDER BY a, b) - 1)::INTEGER AS pos, a, b, hd,
               CASE WHEN hd THEN x::DOUBLE END AS x, CASE WHEN hd THEN y::DOUBLE END AS y,
               CASE WHEN hd THEN w::DOUBLE END AS w, CASE WHEN hd THEN h::DOUBLE END AS h FROM pairing""",
    "front0": """
        SELECT plan_id, 1 AS variant, (x0 + o_custkey % (x1 - x0 + 1))::DOUBLE AS x, y0::DOUBLE AS y, 8::DOUBLE AS w, 2::DOUBLE AS h
        FROM outl JOIN orders ON ok = o_orderkey WHERE o_orderstatus <> 'P'""",
    "centre": f"""
        SELECT plan_id, variant, rid, type, {mean(xs('coords'))} AS cx, {mean(ys('coords'))} AS cy
        FROM room0 WHERE type <> '{OUTLINE}'""",
    "rel0": f"""
        SELECT a.plan_id, a.variant, (row_number() OVER (PARTITION BY a.plan_id ORDER BY a.rid, b.rid) - 1)::INTEGER AS pos,
               a.rid AS a, b.rid AS b, {built('(b.cx - a.cx)', '(b.cy - a.cy)')} AS direction
        FROM centre a JOIN centre b ON a.plan_id = b.plan_id AND a.rid < b.rid""",
    "plan0": "SELECT DISTINCT plan_id, 1 AS variant FROM box",
}


def with_ctes(body, extra=None):
    """Prefix a SELECT with the CTEs it uses, directly or through others, in definition order."""
    known = {**CTES, **(extra or {})}
    needed, queue = set(), [body]
    while queue:
        text = queue.pop()
        for name in known:
            if name not in needed and re.search(rf"\b{name}\b", text):
                needed.add(name)
                queue.append(known[name])
    if not needed:
        return body
    parts = [f"{n} AS MATERIALIZED ({known[n]})" for n in known if n in needed]
    return "WITH " + ",\n".join(parts) + "\n" + body
