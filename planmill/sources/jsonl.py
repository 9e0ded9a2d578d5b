"""JSON-lines plans: lenient scan, directory priority, lookup, sinks."""

import re
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from planmill.constants import SHARD_RECORDS
from planmill.operators.numbering import number_rows
from planmill.operators.rows import keep_rows

# Numbers are read as text first: they may be integers, floats or text. Door-shaped fields stay raw
# text, because they may be null, an object or a list.
TEXT_SCHEMA = (
    "plan_id string, rooms array<struct<rid:string,type:string,coords:array<string>>>,"
    " edges array<struct<pair:array<string>,doors:string,door:string>>, front_door string,"
    " spatial array<array<string>>, _corrupt string"
)
DOOR = "struct<x:float,y:float,w:float,h:float>"
FIRST_FILE = "single_output.jsonl"


def scan_lines(spark: SparkSession, paths, pattern: str = "*.jsonl") -> DataFrame:
    """(value, file, priority, split, row) of all lines, blank ones too; the single-output file comes first.

    `split` is where the line's part of the file begins, `row` grows with the lines of that part.
    """
    lines = spark.read.option("pathGlobFilter", pattern).text(paths)
    return with_priority(
        lines.select(
            "value", F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("split"),
            F.monotonically_increasing_id().alias("row"),
        )
    )


def read_lines(spark: SparkSession, folder: str, pattern: str = "*.jsonl") -> DataFrame:
    """The non-blank lines of `scan_lines`."""
    return keep_rows(scan_lines(spark, folder, pattern), "trim(value) <> ''")


def number_lines(rows: DataFrame, scanned: DataFrame) -> DataFrame:
    """`rows`, some lines of `scanned`, with `line` in place of split and row: 1, 2, .. in the file, blank lines counted.

    Each part of a file is counted by itself, and the parts before it are added up, so a file of any
    size is numbered by many tasks. File names are taken to be unique in the scan.
    """
    parts = scanned.groupBy("file", "split").agg(F.min("row").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    line = F.col("_before") + F.col("row") - F.col("_first") + 1
    return rows.join(parts, ["file", "split"]).withColumn("line", line).drop("split", "row", "_first", "_n", "_before")


def scan_json(lines: DataFrame, schema: str, column: str = "value"):
    """(good rows with `record` of the given fields, rejected rows): text that is not a JSON object is rejected.

    Fields of another type are null, as are missing ones. All columns of the lines stay in both.
    """
    options = "map('mode', 'PERMISSIVE', 'columnNameOfCorruptRecord', '_bad')"
    parsed = lines.withColumn("record", F.expr(f"from_json({column}, '{schema}, _bad string', {options})"))
    # A field of another type marks the record too; only text that is no object at all is rejected.
    odd = f"record is null or (record._bad is not null and try_parse_json({column}) is null) or left(ltrim({column}), 1) <> '{{'"
    names = [f.name for f in parsed.schema["record"].dataType if f.name != "_bad"]
    clean = keep_rows(parsed, f"not coalesce({odd}, true)").withColumn("record", F.struct(*[F.col(f"record.{n}") for n in names]))
    return clean, keep_rows(parsed, f"coalesce({odd}, true)").drop("record")


def with_priority(lines: DataFrame) -> DataFrame:
    return lines.withColumn("priority", (F.col("file") != FIRST_FILE).cast("int"))


def parse_lines(lines: DataFrame) -> DataFrame:
    """Add the raw record `raw`; `raw._corrupt` holds text that is not JSON.

    Room numbers, coordinates and pairs are whole numbers afterwards (fractions cut off), null where
    the text is no number.
    """
    options = "map('mode', 'PERMISSIVE', 'columnNameOfCorruptRecord', '_corrupt')"
    typed = (
        "if(_text is null, null, named_struct('plan_id', _text.plan_id,"
        f" 'rooms', transform(_text.rooms, r -> named_struct('rid', {whole('r.rid')}, 'type', r.type,"
        f" 'coords', transform(r.coords, c -> {whole('c')}))),"
        f" 'edges', transform(_text.edges, e -> named_struct('pair', transform(e.pair, p -> {whole('p')}),"
        " 'doors', e.doors, 'door', e.door)),"
        " 'front_door', _text.front_door, 'spatial', _text.spatial, '_corrupt', _text._corrupt))"
    )
    parsed = lines.withColumn("_text", F.expr(f"from_json(value, '{TEXT_SCHEMA}', {options})"))
    return parsed.withColumn("raw", F.expr(typed)).drop("_text")


def whole(text: str) -> str:
    """SQL text: number text as an integer, its fraction cut off; null for other text."""
    return f"coalesce(try_cast({text} as int), try_cast(try_cast({text} as double) as int))"


def door_list(text: str) -> str:
    """SQL text: null -> [], object -> [object], list -> list, all floats."""
    empty = f"cast(array() as array<{DOOR}>)"
    return (
        f"case when {text} is null or {text} = 'null' then {empty}"
        f" when startswith(ltrim({text}), '{{') then array(from_json({text}, '{DOOR}'))"
        f" else from_json({text}, 'array<{DOOR}>') end"
    )


def normalize(records: DataFrame) -> DataFrame:
    """Canonical columns plus `reason`, which is null for a good record."""
    doors = door_list("if(e.doors is null or e.doors in ('[]', 'null', '{}'), e.door, e.doors)")
    hole = "d is null or d.x is null or d.y is null or d.w is null or d.h is null"
    shaped = records.withColumns(
        {
            "_edges": F.expr(f"transform(raw.edges, e -> named_struct('pair', slice(e.pair, 1, 2), 'door', {doors}))"),
            "_front": F.expr(door_list("raw.front_door")),
        }
    )
    reason = F.expr(
        "case when raw is null or raw._corrupt is not null then 'not_json'"
        " when raw.plan_id is null then 'missing_plan_id' when raw.rooms is null then 'missing_rooms'"
        " when raw.edges is null then 'missing_edges' when raw.spatial is null then 'missing_spatial'"
        " when exists(raw.rooms, r -> r.rid is null or r.type is null or r.coords is null or exists(r.coords, c -> c is null)) then 'room_field'"
        " when exists(raw.edges, e -> e.pair is null or size(e.pair) < 2) then 'short_pair'"
        " when exists(raw.edges, e -> e.pair[0] is null or e.pair[1] is null) then 'bad_pair'"
        " when exists(raw.spatial, t -> t is null or size(t) < 3) then 'short_relation'"
        f" when exists(raw.spatial, t -> {whole('t[0]')} is null or {whole('t[1]')} is null or t[2] is null) then 'bad_relation'"
        f" when exists(_front, d -> {hole}) or exists(_edges, e -> e.door is null or exists(e.door, d -> {hole})) then 'door_field' end"
    )
    kept = [c for c in ("value", "file", "priority", "split", "row") if c in records.columns]
    return shaped.select(
        *kept,
        F.col("raw.plan_id").alias("plan_id"),
        F.expr("raw.rooms").alias("rooms"),
        F.col("_edges").alias("edges"),
        F.col("_front").alias("front_door"),
        F.expr(
            f"transform(raw.spatial, t -> named_struct('rid_a', {whole('get(t, 0)')}, 'rid_b', {whole('get(t, 1)')}, 'direction', get(t, 2)))"
        ).alias("spatial"),
        reason.alias("reason"),
    )


def ingest(lines: DataFrame):
    """(good canonical plans, quarantine with reason codes)."""
    marked = normalize(parse_lines(lines))
    columns = ["plan_id", "rooms", "edges", "front_door", "spatial"]
    quarantine = [c for c in ("file", "value", "split", "row") if c in marked.columns]
    return (
        keep_rows(marked, "reason is null").select(*columns),
        keep_rows(marked, "reason is not null").select("plan_id", "reason", *quarantine),
    )


def ingest_folder(spark: SparkSession, folder: str, pattern: str = "*.jsonl"):
    """(good canonical plans, quarantine with reason, file and line) of a folder of JSON lines."""
    return ingest_scanned(scan_lines(spark, folder, pattern))


def ingest_scanned(scanned: DataFrame):
    """As `ingest_folder`, of lines that `scan_lines` gives; only rejected lines are numbered."""
    good, bad = ingest(keep_rows(scanned, "trim(value) <> ''"))
    return good, number_lines(bad, scanned)


def _place(lines: DataFrame) -> list[str]:
    """Columns that order lines: file priority and name, place in the file where known, text."""
    return [c for c in ("priority", "file", "split", "row", "value") if c in lines.columns]


def first_by_priority(lines: DataFrame) -> DataFrame:
    """(plan_id, file, value, n_copies): the first line of each plan id by file priority, file name and place.

    Lines without a known place go by their text. A partial aggregate, so a plan id with very many copies
    is reduced before the shuffle.
    """
    keyed = keep_rows(lines.withColumn("plan_id", F.get_json_object("value", "$.plan_id")), "plan_id is not null")
    place = _place(lines)
    # The file does not need the text, which goes along only where it is asked for.
    return keyed.groupBy("plan_id").agg(
        F.min(F.struct(*[c for c in place if c != "value"])).alias("m"), F.min(F.struct(*place)).alias("v"), F.count(F.lit(1)).alias("n_copies")
    ).select("plan_id", "m.file", "v.value", "n_copies")


def find_plan(lines: DataFrame, plan_id: str) -> DataFrame:
    """The first line of one plan id across files in priority order."""
    hit = F.get_json_object("value", "$.plan_id") == str(plan_id)
    return lines.filter(hit).orderBy(*_place(lines)).limit(1)


def to_lines(df: DataFrame) -> DataFrame:
    """Canonical plans -> JSON lines with `doors` lists, null front doors and relation triples."""
    return df.select(
        "plan_id",
        F.expr(
            "to_json(named_struct('plan_id', plan_id, 'rooms', rooms,"
            " 'edges', transform(edges, e -> named_struct('pair', e.pair, 'doors', e.door)),"
            " 'front_door', get(front_door, 0),"
            " 'spatial', transform(spatial, s -> array(cast(s.rid_a as string), cast(s.rid_b as string), s.direction))),"
            " map('ignoreNullFields', 'false'))"
        ).alias("value"),
    )


# --- shard sets -------------------------------------------------------------------------------
#
# folder/data/<batch>-<attempt>/shard=<n>/...   lines of one shard, written by one task
# folder/manifest/<batch>                       one JSON row for a batch that is whole
#
# A batch counts once its manifest row is there, which is written last. What a run that broke off left
# in data/ is in no manifest and is never read; running the batch again writes a new attempt.

MANIFEST = "batch string, data string, first_shard long, shards long, records long"


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    """(batch, data, first_shard, shards, records) of the batches of a shard set; none of a new one."""
    try:
        return spark.read.schema(MANIFEST).json(f"{folder}/manifest/*")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], MANIFEST)


def append_batch(lines: DataFrame, folder: str, batch: str, order: list[str], records: int = SHARD_RECORDS) -> bool:
    """Add lines (`value` and order columns) to a shard set as one batch; False if that batch is in it already.

    All shards of a batch but its last hold exactly `records` lines, in the order given: lines get gapless
    numbers over sorted tasks, and a shard is written by the one task that holds its numbers. Shard numbers
    go on from the batches before. A batch that was appended is not appended again, so a job may be
    run twice. One writer at a time.
    """
    if not re.fullmatch(r"[A-Za-z0-9._-]+", batch) or batch.startswith((".", "_")):
        raise ValueError(f"not a batch name: {batch!r}")
    spark = lines.sparkSession
    # One row a batch: its number and what it holds; the driver needs their end and whether this one is there.
    known = manifest(spark, folder).agg(
        F.max(F.col("first_shard") + F.col("shards")).alias("next"), F.count(F.when(F.col("batch") == batch, 1)).alias("own")
    ).first()
    if known["own"]:
        return False
    first = known["next"] or 0
    names = list(dict.fromkeys([*order, "value"]))
    numbered = number_rows(lines.select(*names), [], order, "number")
    placed = numbered.select(F.expr(f"cast((number - 1) div {records} as bigint)").alias("shard"), "number", "value")
    data = f"{batch}-{uuid.uuid4().hex}"
    seen = Observation("append")
    counted = placed.repartition("shard").sortWithinPartitions("shard", "number").observe(seen, F.count(F.lit(1)).alias("n"))
    counted.select("shard", "value").write.partitionBy("shard").text(f"{folder}/data/{data}")
    n = seen.get["n"]
    row = spark.createDataFrame([(batch, data, first, -(-n // records), n)], MANIFEST)
    row.coalesce(1).write.mode("overwrite").json(f"{folder}/manifest/{batch}")
    return True


def scan_set(spark: SparkSession, folder: str) -> DataFrame:
    """`scan_lines` of a shard set, with `batch` and `shard`; `file` is floorplans_<shard>.jsonl."""
    batches = manifest(spark, folder).filter("shards > 0").select("batch", "data", "first_shard")
    # A name a batch, not a line or shard.
    names = [r["data"] for r in batches.select("data").collect()]
    if not names:
        return with_priority(spark.createDataFrame([], "value string, split long, row long, batch string, shard long, file string"))
    lines = spark.read.option("recursiveFileLookup", "true").text([f"{folder}/data/{n}" for n in names]).select(
        "value", F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("row"),
        F.regexp_extract("_metadata.file_path", "/data/([^/]+)/shard=", 1).alias("data"),
        F.regexp_extract("_metadata.file_path", "shard=([0-9]+)/[^/]*$", 1).cast("long").alias("shard"),
    )
    placed = lines.join(F.broadcast(batches), "data").withColumn("shard", F.col("shard") + F.col("first_shard")).drop("data", "first_shard")
    return with_priority(placed.withColumn("file", F.concat(F.lit("floorplans_"), F.format_string("%04d", "shard"), F.lit(".jsonl"))))


def write_shards(df: DataFrame, folder: str, records: int = SHARD_RECORDS, mode: str = "errorifexists") -> None:
    """JSON lines with at most `records` plans per file; mode 'append' adds to an existing set.

    Plain text files without a manifest: files may hold fewer plans, and an append that runs twice
    doubles them. `append_batch` does neither.
    """
    to_lines(df).select("value").write.mode(mode).option("maxRecordsPerFile", records).text(folder)
