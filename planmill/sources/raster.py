"""Label rasters: image folders, pixel tables, run tables, and rasters drawn from the tables."""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from planmill.constants import CODE_EXTERNAL, CODE_FRONT_DOOR, CODE_INTERIOR_DOOR
from planmill.sources import tables

#: Sides of the drawn rasters, and the longest side of any raster (labels are y * 65536 + x).
SIDE = 64
MAX_SIDE = 65536

# First code of each final room type.
TYPE_CODES = {
    "livingroom": 0, "bedroom": 1, "kitchen": 2, "bathroom": 3,
    "studyroom": 6, "balcony": 9, "entrance": 10, "storage": 11,
}


def read_images(spark: SparkSession, folder: str, pattern: str = "*.png") -> DataFrame:
    """(plan_id = file stem, origin, height, width, channels, data, ok); see `with_faults` for ok."""
    df = spark.read.format("image").option("dropInvalid", False).option("pathGlobFilter", pattern).load(folder)
    stem = F.regexp_replace(F.element_at(F.split("image.origin", "/"), -1), r"\.[^.]*$", "")
    found = df.select(
        stem.alias("plan_id"), "image.origin", "image.height", "image.width", F.col("image.nChannels").alias("channels"), "image.data",
    )
    return with_faults(found).withColumn("ok", F.col("fault").isNull()).drop("fault")


def own_fault():
    """What is wrong with a raster by itself, null for nothing: unreadable, channels, side or size."""
    n_bytes = F.col("height").cast("long") * F.col("width") * 4
    return (
        F.when(F.coalesce(F.col("height") <= 0, F.lit(True)) | F.coalesce(F.col("width") <= 0, F.lit(True)), "unreadable")
        .when(F.coalesce(F.col("channels") != 4, F.lit(True)), "channels")
        .when(F.greatest("height", "width") > MAX_SIDE, "side")
        .when(F.coalesce(F.octet_length("data") != n_bytes, F.lit(True)), "size")
    )


def with_faults(images: DataFrame) -> DataFrame:
    """Adds `fault`, null for a raster that can be used: unreadable, channels, side, size or duplicate_id.

    Of rasters with one plan_id the first by origin stays. Only the keys are counted over tasks; ids
    that stand once, nearly all, never move a raster.
    """
    return with_copies(images.withColumn("fault", own_fault()), images)


def with_copies(marked: DataFrame, keys: DataFrame) -> DataFrame:
    """`marked` with the `fault` duplicate_id where an id (plan_id) stands in `keys` with an earlier origin."""
    several = (
        keys.groupBy(F.col("plan_id").alias("_id")).agg(F.min("origin").alias("_first"), F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    )
    joined = marked.join(several, F.col("plan_id").eqNullSafe(F.col("_id")), "left")
    later = F.col("_first").isNotNull() & (F.col("origin") > F.col("_first"))
    return joined.withColumn("fault", F.when(later, "duplicate_id").otherwise(F.col("fault"))).drop("_id", "_first", "_n")


def image_codes(height: int, width: int, data: bytes) -> np.ndarray:
    """Codes (second channel) of a raster; data of another size is a ValueError."""
    return np.frombuffer(data, np.uint8).reshape(height, width, 4)[:, :, 1]


def code_runs(codes: np.ndarray):
    """(y, x0, x1, g) of the runs of equal codes, in raster order: where a code differs from the one before."""
    height, width = codes.shape
    opens = np.ones((height, width), bool)
    opens[:, 1:] = codes[:, 1:] != codes[:, :-1]
    at = np.flatnonzero(opens)
    last = np.append(at[1:], height * width) - 1
    return at // width, at % width, last % width, codes.reshape(-1)[at]


#: Rasters of at most so many pixels are read together.
SMALL = 1 << 16


def runs_of(rasters, read=lambda codes: codes):
    """(i, y, x0, x1, g) of the runs of all rasters of a list of (i, codes), each as `read` gives it.

    Small ones of equal sides are read as one, below each other.
    """
    piles: dict = {}
    for i, codes in rasters:
        piles.setdefault(codes.shape if codes.size <= SMALL else i, []).append((i, codes))
    found = []
    for pile in piles.values():
        owner = np.array([i for i, _ in pile])
        y, x0, x1, g = code_runs(read(np.concatenate([c for _, c in pile]) if len(pile) > 1 else pile[0][1]))
        k, y = np.divmod(y, len(pile[0][1]))
        found.append((owner[k], y, x0, x1, g))
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))


def image_parts(batches, images: int = 64):
    """Lists of (row, plan_id, codes or the reason why there are none) of at most `images` rasters."""
    for batch in batches:
        for begin in range(0, batch.num_rows, images):
            part = batch.slice(begin, images)
            out = []
            for i, (h, w, data) in enumerate(zip(*(part.column(c) for c in (1, 2, 3)), strict=True)):
                try:
                    out.append((i, image_codes(h.as_py(), w.as_py(), data.as_buffer())))
                except (ValueError, TypeError, AttributeError) as e:
                    out.append((i, type(e).__name__))
            yield part.column(0), out


def runs_from_images(images: DataFrame, made=None) -> DataFrame:
    """(plan_id, y, x0, x1, g): runs of equal codes of the second channel, in one pass over the bytes.

    `made` turns batches of other rows into what `image_parts` gives, so that rasters that a task paints do not leave it.
    """
    kind = images.schema["plan_id"].dataType.simpleString()

    def rows(batches):
        for ids, rasters in (made or image_parts)(batches):
            found = [(i, codes) for i, codes in rasters if not isinstance(codes, str)]
            if found:
                owner, *columns = runs_of(found)
                columns = [pa.array(c.astype(np.int32)) for c in columns]
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(owner)), *columns], ["plan_id", "y", "x0", "x1", "g"])

    good = images.filter("ok") if "ok" in images.columns else images
    return (good if made else good.select("plan_id", "height", "width", "data")).mapInArrow(rows, f"plan_id {kind}, y int, x0 int, x1 int, g int")


def pixels_from_runs(runs: DataFrame) -> DataFrame:
    """(plan_id, y, x, g)."""
    return runs.select("plan_id", "y", F.explode(F.sequence("x0", "x1")).alias("x"), "g")


def runs_from_pixels(pixels: DataFrame, keys=("plan_id", "g")) -> DataFrame:
    """Neighbouring pixels of a row with the same code become one run.

    The pixels of one row of one code are gathered, at most as many as a raster is wide, and a task
    cuts the sorted places of a whole batch at once where two neighbours are not adjacent.
    """
    grouped = pixels.groupBy(*keys, "y").agg(F.array_sort(F.collect_list(F.col("x").cast("int"))).alias("xs"))
    n = len(keys) + 1

    def rows(batches):
        for batch in batches:
            lists = batch.column(n)
            x = lists.flatten().to_numpy()
            owner = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()))
            opens = np.append(True, (np.diff(x) > 1) | (np.diff(owner) > 0))[: len(x)]
            first = np.flatnonzero(opens)
            last = np.append(first[1:], len(x))[: len(first)] - 1
            held = [batch.column(k).take(pa.array(owner[first])) for k in range(n)]
            yield pa.RecordBatch.from_arrays(
                [*held, pa.array(x[first], pa.int32()), pa.array(x[last], pa.int32())], [*batch.schema.names[:n], "x0", "x1"]
            )

    fields = "".join(f"`{k}` {pixels.schema[k].dataType.simpleString()}, " for k in (*keys, "y"))
    return grouped.mapInArrow(rows, fields + "x0 int, x1 int")


def drawn_rects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(plan_id, rects): rectangles of all plans at quarter resolution, in the order in which they are painted.

    Later rooms cover earlier ones, doors cover rooms, and the front door covers all.
    """
    codes = "map(" + ", ".join(f"'{t}', {c}" for t, c in TYPE_CODES.items()) + ")"
    plans = tables.plans(spark, sf_dir)
    ring = "transform(filter(sequence(0, 11), k -> k < size(r.coords)), k -> cast(r.coords[k] div 4 as int))"
    rects = f"""concat(
      flatten(transform(filter(rooms, r -> r.rid > 0), r -> transform(array({ring}), q -> concat(
        array(named_struct('p', r.rid, 'g', {codes}[r.type], 'xa', q[0], 'xb', if(size(q) = 12, q[8], q[4]) - 1, 'ya', q[1], 'yb', q[3] - 1)),
        if(size(q) = 12, array(named_struct('p', r.rid, 'g', {codes}[r.type], 'xa', q[0], 'xb', q[4] - 1, 'ya', q[7], 'yb', q[3] - 1)),
          slice(array(named_struct('p', r.rid, 'g', 0, 'xa', 0, 'xb', 0, 'ya', 0, 'yb', 0)), 1, 0))))[0])),
      transform(filter(edges, e -> size(e.door) > 0), e -> named_struct('p', 100, 'g', {CODE_INTERIOR_DOOR},
        'xa', cast(floor(e.door[0].x / 4) as int) - 1, 'xb', cast(floor(e.door[0].x / 4) as int) + cast(e.door[0].w as int) % 4,
        'ya', cast(floor(e.door[0].y / 4) as int) - 1, 'yb', cast(floor(e.door[0].y / 4) as int) + cast(e.door[0].h as int) % 3)),
      transform(front_door, d -> named_struct('p', 200, 'g', {CODE_FRONT_DOOR}, 'xa', cast(floor(d.x / 4) as int),
        'xb', cast(floor(d.x / 4) as int) + 2, 'ya', cast(floor(d.y / 4) as int), 'yb', cast(floor(d.y / 4) as int))))"""
    return plans.select("plan_id", F.expr(f"array_sort({rects})").alias("rects"))


def paint(batches):
    """As `image_parts`, the rasters of batches of `drawn_rects`; what nothing covers is external (13)."""
    for batch in batches:
        for begin in range(0, batch.num_rows, 256):
            part = batch.slice(begin, 256)
            lists = part.column(1)
            flat = lists.flatten()
            columns = [flat.field(f).to_numpy(zero_copy_only=False) for f in ("g", "xa", "xb", "ya", "yb")]
            owner = np.repeat(np.arange(part.num_rows), np.diff(lists.offsets.to_numpy()))
            codes = np.full((part.num_rows, SIDE, SIDE), CODE_EXTERNAL, np.uint8)
            for k, g, xa, xb, ya, yb in zip(owner.tolist(), *(c.tolist() for c in columns), strict=True):
                codes[k, ya : yb + 1, xa : xb + 1] = g
            yield part.column(0), list(enumerate(codes))


def drawn_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(plan_id, origin, height, width, channels, data): rasters of all plans; a task paints those of its own plans."""
    def files(batches):
        for ids, rasters in paint(batches):
            data = np.zeros((len(rasters), SIDE, SIDE, 4), np.uint8)
            for i, codes in rasters:
                data[i, :, :, 1] = codes
            yield pa.RecordBatch.from_arrays([ids, pa.array([d.tobytes() for d in data], pa.binary())], ["plan_id", "data"])

    painted = drawn_rects(spark, sf_dir).mapInArrow(files, "plan_id string, data binary")
    return painted.select(
        "plan_id", F.concat(F.lit("plans/"), "plan_id", F.lit(".png")).alias("origin"),
        F.lit(SIDE).alias("height"), F.lit(SIDE).alias("width"), F.lit(4).alias("channels"), "data",
    )


def damaged_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drawn rasters, some with a planted fault that the plan number decides, some twice."""
    k = F.col("plan_id").cast("long")
    plain = drawn_images(spark, sf_dir)
    empty = F.repeat(F.lit(chr(CODE_EXTERNAL) * 4), SIDE * SIDE).cast("binary")
    spoiled = plain.withColumns(
        {
            "height": F.when(k % 97 == 0, -1).otherwise(F.col("height")),
            "channels": F.when(k % 89 == 0, 3).otherwise(F.col("channels")),
            "data": F.when(k % 83 == 0, F.substring("data", 1, SIDE)).when(k % 73 == 0, empty).otherwise(F.col("data")),
            "copies": F.when(k % 79 == 0, F.array(F.lit("plans/"), F.lit("plans2/"))).otherwise(F.array(F.lit("plans/"))),
        }
    )
    return spoiled.withColumn("folder", F.explode("copies")).select(
        "plan_id", F.concat("folder", "plan_id", F.lit(".png")).alias("origin"), "height", "width", "channels", "data"
    )


def drawn_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(plan_id, y, x, g) of the drawn rasters; external cells are not listed."""
    return pixels_from_runs(runs_from_images(drawn_rects(spark, sf_dir), paint).filter(F.col("g") != CODE_EXTERNAL))


__all__ = [
    "CODE_EXTERNAL", "code_runs", "damaged_images", "drawn_images", "drawn_pixels", "drawn_rects", "image_codes", "image_parts",
    "own_fault", "paint", "pixels_from_runs", "read_images", "runs_from_images", "runs_from_pixels", "runs_of", "with_copies", "with_faults",
]
