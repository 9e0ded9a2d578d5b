"""Row views, type merging, filters and the drop-applied view of plans."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planmill.constants import CODE_NAMES, MAX_COORD, MAX_RID, MERGED_NAMES, OUTLINE
from planmill.operators.rows import keep_rows

_DOUBLE_DOOR = "named_struct('x', cast(d.x as double), 'y', cast(d.y as double), 'w', cast(d.w as double), 'h', cast(d.h as double))"


def row_view(df: DataFrame) -> DataFrame:
    """Working view of a plan: one struct per room, edge and relation, doors as doubles.

    Accepts array<struct> columns or struct-of-arrays columns, and is idempotent.
    """
    return df.withColumns(
        {
            "rooms": F.expr(_as_structs(df, "rooms", ("rid", "type", "coords"))),
            "edges": F.expr(
                f"transform({_as_structs(df, 'edges', ('pair', 'door'))}, e -> named_struct('pair', e.pair,"
                f" 'door', transform({_doors(df)}, d -> {_DOUBLE_DOOR})))"
            ),
            "front_door": F.expr(
                f"transform({_as_structs(df, 'front_door', ('x', 'y', 'w', 'h'))}, d -> {_DOUBLE_DOOR})"
            ),
            "spatial": F.expr(_as_structs(df, "spatial", ("rid_a", "rid_b", "direction"))),
        }
    )


def _as_structs(df, column, fields):
    if df.schema[column].dataType.typeName() == "array":
        return column
    zipped = ", ".join(f"{column}.{f}" for f in fields)
    names = ", ".join(f"'{f}', z.`{f}`" for f in fields)
    return f"transform(arrays_zip({zipped}), z -> named_struct({names}))"


def _doors(df):
    edges = df.schema["edges"].dataType
    holder = edges.elementType if edges.typeName() == "array" else edges
    door = holder["door"].dataType
    if edges.typeName() == "struct":
        door = door.elementType
    if door.typeName() == "array":
        return "e.door"
    return "arrays_zip(e.door.x, e.door.y, e.door.w, e.door.h)"


def columnar_view(df: DataFrame) -> DataFrame:
    """Struct-of-arrays view (the inverse of `row_view`)."""
    def pull(column, fields, door_fields=()):
        parts = [f"'{f}', transform({column}, z -> z.{f})" for f in fields]
        parts += [
            f"'{f}', transform({column}, z -> named_struct("
            + ", ".join(f"'{k}', transform(z.{f}, d -> d.{k})" for k in "xywh")
            + "))"
            for f in door_fields
        ]
        return F.expr(f"named_struct({', '.join(parts)})")

    return df.withColumns(
        {
            "rooms": pull("rooms", ("rid", "type", "coords")),
            "edges": pull("edges", ("pair",), ("door",)),
            "front_door": pull("front_door", ("x", "y", "w", "h")),
            "spatial": pull("spatial", ("rid_a", "rid_b", "direction")),
        }
    )


def unify_rows(df: DataFrame) -> DataFrame:
    """Raw rows as written to JSONL -> working rows: `doors` renamed, relation lists to structs."""
    edge = df.schema["edges"].dataType.elementType
    names = edge.fieldNames()
    door = "coalesce(e.door, e.doors)" if {"door", "doors"} <= set(names) else (
        "e.doors" if "doors" in names else "e.door"
    )
    out = df.withColumn(
        "edges", F.expr(f"transform(edges, e -> named_struct('pair', e.pair, 'door', {door}))")
    )
    if df.schema["spatial"].dataType.elementType.typeName() == "array":
        out = out.withColumn(
            "spatial",
            F.expr(
                "transform(spatial, s -> named_struct('rid_a', cast(s[0] as int),"
                " 'rid_b', cast(s[1] as int), 'direction', s[2]))"
            ),
        )
    return out


def merge_types(df: DataFrame, code="code") -> DataFrame:
    """Room code -> merged room type; rows with an unmapped code are dropped.

    The 13-entry mapping is part of the expression, so no join and no shuffle is needed.
    """
    entries = ", ".join(f"{c}, '{MERGED_NAMES.get(n, n)}'" for c, n in CODE_NAMES.items())
    return df.withColumn("type", F.expr(f"try_element_at(map({entries}), cast({code} as int))")).filter(
        F.col("type").isNotNull()
    )


def final_types(codes: DataFrame) -> DataFrame:
    """Distinct merged names, outline excluded, in alphabetical order."""
    return codes.select("type").filter(F.col("type") != OUTLINE).distinct().orderBy("type")


def keep_plans(df: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows whose plan id (compared as string) is listed in `wanted.plan_id`."""
    keys = wanted.select(F.col("plan_id").cast("string").alias("plan_id"))
    return df.withColumn("plan_id", F.col("plan_id").cast("string")).join(keys, "plan_id", "left_semi")


def first_plans(df: DataFrame, n: int) -> DataFrame:
    """The first n plans by id; a top-n, so each task sends at most n rows."""
    return df.orderBy(F.col("plan_id").cast("long"), "plan_id").limit(n)


def split_unrepresentable(df: DataFrame):
    """(good, quarantine): plans whose rooms or coordinates have no token get a reason code."""
    reason = F.expr(
        f"case when size(filter(rooms, r -> r.type <> '{OUTLINE}')) > {MAX_RID} then 'too_many_rooms' "
        f"when exists(rooms, r -> exists(r.coords, v -> v < 0 or v > {MAX_COORD})) then 'coord_out_of_range' "
        f"when exists(front_door, d -> {_no_token('d')}) or exists(edges, e -> exists(e.door, d -> {_no_token('d')})) "
        f"then 'door_out_of_range' end"
    )
    marked = df.withColumn("reason", reason)
    return keep_rows(marked, "reason is null").drop("reason"), keep_rows(marked, "reason is not null")


def _no_token(d):
    return " or ".join(
        f"not (rint({d}.{k}) between 0 and {MAX_COORD})" for k in "xywh"
    )


def drop_applied_view(df: DataFrame) -> DataFrame:
    """What the condition shows after drops: noisy coordinates, missing parts removed.

    A door list is emptied by mode 'all' at the fate's own index in the edge list that is left
    after edge drops.
    """
    rooms = (
        "transform(filter(zip_with(rooms, room_fate, (r, f) -> named_struct('r', r, 'f', f)), z -> not z.f.gone),"
        " z -> named_struct('rid', z.r.rid, 'type', if(z.f.no_type, 'unknown', z.r.type),"
        " 'coords', if(z.f.no_coords, cast(array() as array<int>), coalesce(z.f.noisy, z.r.coords))))"
    )
    kept = "transform(filter(zip_with(edges, edge_fate, (e, f) -> named_struct('e', e, 'f', f)), z -> not z.f.gone), z -> z.e)"
    return (
        df.withColumn("_kept", F.expr(kept))
        .withColumns(
            {
                "rooms": F.expr(rooms),
                "edges": F.expr(
                    "transform(_kept, (e, i) -> named_struct('pair', e.pair, 'door',"
                    " if(coalesce(edge_fate[i].door_mode, '') = 'all', filter(e.door, d -> false), e.door)))"
                ),
                "front_door": F.expr("if(front_gone or front_bare, filter(front_door, d -> false), front_door)"),
                "spatial": F.expr("filter(spatial, (s, i) -> not rel_gone[i])"),
            }
        )
        .drop("_kept")
    )
