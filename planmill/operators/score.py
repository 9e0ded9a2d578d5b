"""Rule-based scores of parsed answers against the plan they were asked for.

Every score is a column expression over the facts of one row that holds the parsed answer and the plan's metadata. A
sequence is parsed once, matched once, and all facts come out of one pass over Arrow batches (`facts`). The gate
(`format`) is checked first and guards the expensive scores.
"""

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planmill.constants import OUTLINE
from planmill.functions.arrays import let
from planmill.operators.facts import facts
from planmill.operators.shapes import shapes

REWARDS = ["format", "count_total", "count_type", "orthogonality", "no_overlap", "connectivity", "spatial"]


@dataclass(frozen=True)
class Reward:
    enabled: bool = True
    weight: float = 1.0
    credit: bool = False
    penalty: float = 1.0


@dataclass(frozen=True)
class RewardConfig:
    """Default weights and penalties of the seven scores."""

    rewards: dict = field(
        default_factory=lambda: {
            "format": Reward(weight=1.0, credit=True, penalty=2.0),
            "count_total": Reward(weight=0.5),
            "count_type": Reward(weight=1.0),
            "orthogonality": Reward(weight=1.5, credit=True, penalty=1.5),
            "no_overlap": Reward(weight=2.0, credit=True, penalty=2.0),
            "connectivity": Reward(weight=1.0),
            "spatial": Reward(weight=0.5),
        }
    )


NO_INTS = "cast(array() as array<int>)"


def metadata(df: DataFrame) -> DataFrame:
    """`meta`: room total, counts per type, and the plan's rooms, edges and relations."""
    rooms = f"filter(rooms, r -> r.type <> '{OUTLINE}')"
    types = f"transform({rooms}, r -> r.type)"
    return df.withColumn(
        "meta",
        F.expr(
            f"named_struct('total_rooms', size({rooms}), 'type_counts', map_from_entries(transform("
            f"array_sort(array_distinct({types})), t -> struct(t, size(filter({rooms}, r -> r.type = t))))),"
            f" 'edges', edges, 'spatial', spatial, 'rooms', rooms)"
        ),
    )


# --- single scores -------------------------------------------------------------------------

def format_score():
    return "if(parsed.success and size(parsed.rooms) >= 2, 1D, 0D)"


def format_errors():
    return (
        f"case when not parsed.success then parsed.errors when size(parsed.rooms) < 2 then"
        f" flatten(transform(parsed.rooms, r -> sequence(r.block_start, r.block_end))) else {NO_INTS} end"
    )


def count_total_score():
    return "if(_shape.n_out = meta.total_rooms, 1D, 0D)"


def count_type_score():
    return "_shape.type_share"


def orthogonality_score():
    return "if(_shape.n_angles = 0, 0D, _shape.n_right / cast(_shape.n_angles as double))"


def orthogonality_errors():
    return "_shape.slanted"


def no_overlap_score():
    return "if(_shape.n_out < 2 or _shape.total <= 0, 1D, 1D - least(_shape.common / _shape.total, 1D))"


def no_overlap_errors():
    return "_shape.marks"


def with_shapes(df: DataFrame, parts: list[str], every_part: bool = True) -> DataFrame:
    """`_shape`: the wanted parts of the geometry of answers that pass the gate; see `shapes`."""
    rooms, doors = (F.expr(f"if(_gate, parsed.{c}, null)") for c in ("rooms", "doors"))
    return df.withColumn("_shape", shapes(rooms, doors, parts, every_part))


# --- matching, connectivity, relations --------------------------------------------------------

def _facts(parts: list[str]):
    """Facts of the wanted parts of rows that pass the gate."""
    given = {
        "rooms": "parsed.rooms", "doors": "parsed.doors", "wanted": "meta.rooms", "edges": "meta.edges", "spatial": "meta.spatial",
        "counts": "map_entries(meta.type_counts)",
    }
    return facts(parts, **{c: F.expr(f"if(_gate, {e}, null)") for c, e in given.items()})


def with_match(df: DataFrame) -> DataFrame:
    """`match`: (rid, out) pairs of the cheapest assignment within each room type; see `matching`.

    Exact for any number of rooms of a type. Ties take the smallest indices.
    """
    return df.withColumn("_shape", _facts(["match"])).withColumn("match", F.expr("if(_gate, _shape.match, null)")).drop("_shape")


def connectivity_score():
    return "_shape.connected"


def spatial_score():
    return "_shape.related"


SCORES = {
    "format": format_score,
    "count_total": count_total_score,
    "count_type": count_type_score,
    "orthogonality": orthogonality_score,
    "no_overlap": no_overlap_score,
    "connectivity": connectivity_score,
    "spatial": spatial_score,
}


def score(df: DataFrame, cfg: RewardConfig = RewardConfig()) -> DataFrame:
    """All enabled scores as `r_<name>` and error indices as `e_<name>`; needs `parsed` and `meta`.

    A sequence that fails the gate gets 0 for every score.
    """
    on = {n for n, r in cfg.rewards.items() if r.enabled}
    out = df.withColumn("_gate", F.expr(f"{format_score()} = 1D"))
    wanted = {
        "count_total": ["outs"], "count_type": ["types"], "orthogonality": ["angles"], "no_overlap": ["outs", "overlaps"],
        "connectivity": ["connected"], "spatial": ["related"],
    }
    parts = list(dict.fromkeys(p for n, ps in wanted.items() if n in on for p in ps))
    if "no_overlap" in on and cfg.rewards["no_overlap"].credit:
        parts.append("marks")
    if parts:
        out = out.withColumn("_shape", _facts(parts))
    columns = {f"r_{n}": F.expr(SCORES[n]() if n == "format" else f"if(_gate, {SCORES[n]()}, 0D)") for n in REWARDS if n in on}
    errors = {"format": format_errors, "orthogonality": orthogonality_errors, "no_overlap": no_overlap_errors}
    for n, e in errors.items():
        if n in on and cfg.rewards[n].credit:
            columns[f"e_{n}"] = F.expr(e() if n == "format" else f"if(_gate, {e()}, {NO_INTS})")
    out = out.withColumns(columns)
    return out.drop("_gate", "_shape")


def error_mask(length: str, indices: str) -> str:
    """SQL text: 0/1 per token; indices outside the sequence are ignored.

    Both texts are evaluated once a row, also where they stand for whole steps and not for columns.
    """
    mask = "transform(filter(sequence(0, q.n), i -> i < q.n), i -> if(array_contains(q.m, i), 1D, 0D))"
    return let(f"named_struct('n', {length}, 'm', {indices})", "q", mask)
