"""The token vocabulary: ordered table, id assignment over a base vocabulary, encode and decode."""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from planmill.constants import (
    DIRECTIONS, MAX_COORD, MAX_RID, OUTLINE, PAD_TOKEN, ROOM_TYPES, STRUCTURE_TOKENS,
)
from planmill.functions.flat import lists_of, ranges
from planmill.operators.rows import keep_rows
from planmill.operators.strict import number

VOCAB_LIMIT = 10_000


def token_table(spark: SparkSession, max_rid=MAX_RID, max_x=MAX_COORD, max_y=MAX_COORD, types=ROOM_TYPES) -> DataFrame:
    """(ord, category, token) in registration order; its size is set by the arguments, not by data."""
    groups = [
        ("coord_x", [f"<X:{v}>" for v in range(max_x + 1)]),
        ("coord_y", [f"<Y:{v}>" for v in range(max_y + 1)]),
        ("room_id", [f"<RID:{v}>" for v in range(max_rid + 1)]),
        ("room_type", [f"<TYPE:{t}>" for t in [*types, OUTLINE]]),
        ("spatial_rel", [f"<REL:{d}>" for d in DIRECTIONS]),
        ("structure_special", [PAD_TOKEN]),
        ("structure", STRUCTURE_TOKENS),
    ]
    rows = [(category, token) for category, tokens in groups for token in tokens]
    return spark.createDataFrame(
        [(i, c, t) for i, (c, t) in enumerate(rows)], "ord int, category string, token string"
    )


def assign_ids(tokens: DataFrame, base: DataFrame) -> DataFrame:
    """Ids after the base vocabulary (token, id): known tokens keep theirs, the pad token comes first.

    The base table is reduced to the few known tokens by a semi-join style lookup and to its
    largest id by a partial aggregate; only the token table is ever ordered.
    """
    small = F.broadcast(tokens.select("token"))
    known = base.join(small, "token").select("token", F.col("id").cast("long").alias("known_id"))
    top = base.agg((F.max("id").cast("long") + 1).alias("base_size"))
    listed = tokens.join(known, "token", "left").join(F.broadcast(top))
    rank = F.row_number().over(
        W.partitionBy(F.col("known_id").isNull()).orderBy((F.col("token") != PAD_TOKEN).cast("int"), "ord")
    )
    return listed.select(
        "ord", "category", "token",
        F.coalesce("known_id", F.col("base_size") + rank - 1).cast("int").alias("id"),
    )


class Codec:
    """Token text <-> id.

    Holds the vocabulary on the driver. Its size is fixed by the vocabulary, is checked when it
    is read, and does not grow with the data; it goes with the tasks, so encoding needs no join and
    no shuffle, and each distinct token of an Arrow batch is looked up once.
    """

    def __init__(self, vocab: DataFrame, numbers: DataFrame | None = None):
        rows = vocab.select("token", "id").limit(VOCAB_LIMIT + 1).collect()
        if len(rows) > VOCAB_LIMIT:
            raise ValueError(f"vocabulary has more than {VOCAB_LIMIT} tokens")
        self.ids = {r["token"]: int(r["id"]) for r in rows}
        self.numbers = {}
        if numbers is not None:
            found = numbers.select("n", "ids").limit(VOCAB_LIMIT + 1).collect()
            if len(found) > VOCAB_LIMIT:
                raise ValueError(f"more than {VOCAB_LIMIT} number tokens")
            self.numbers = {int(r["n"]): [int(i) for i in r["ids"]] for r in found}

    def get(self, token: str) -> int:
        if token not in self.ids:
            raise KeyError(f"token not in the vocabulary: {token!r}")
        return self.ids[token]

    def encode(self, tokens: str):
        """Column of ids; a bare number becomes the base vocabulary's ids for it."""
        ids, numbers = self.ids, self.numbers

        def run(t: pa.Array) -> pa.Array:
            return _encoded(t, ids, numbers)[0]

        return F.arrow_udf(run, "array<int>")(F.expr(tokens))

    def with_encoded(self, df: DataFrame, tokens: str) -> DataFrame:
        """Adds `ids` of a token column and the map between both: `token_of`, the place of the token that each id
        belongs to, and `first_of`, the place of the first id of each token.

        A token without an id has one null id. Places count from 0.
        """
        ids, numbers = self.ids, self.numbers

        def run(t: pa.Array) -> pa.Array:
            return pa.StructArray.from_arrays(_encoded(t, ids, numbers), ["ids", "token_of", "first_of"])

        made = df.withColumn("_made", F.arrow_udf(run, "struct<ids:array<int>,token_of:array<int>,first_of:array<int>>")(F.expr(tokens)))
        return made.withColumns({k: F.col(f"_made.{k}") for k in ("ids", "token_of", "first_of")}).drop("_made")


def _ids_of(token: str | None, ids: dict, numbers: dict) -> list:
    """Ids of one token: several for a bare number, else one, null where it has none."""
    if token is None:
        return [None]
    if numbers and (found := numbers.get(number(token))) is not None:
        return found
    for kind in ("X", "Y", "RID"):
        if token.startswith(f"<{kind}:"):
            return [ids.get(f"<{kind}:{number(token[len(kind) + 2 : -1])}>")]
    return [ids.get(token)]


def _encoded(lists: pa.Array, ids: dict, numbers: dict) -> list[pa.Array]:
    """Lists of ids, of the place of each id's token, and of the place of each token's first id; each token is looked up once a batch."""
    _, length = lists_of(lists)
    none = pa.array(~lists.is_valid().to_numpy(zero_copy_only=False))
    coded = lists.flatten().dictionary_encode(null_encoding="encode")
    known = [_ids_of(t, ids, numbers) for t in coded.dictionary.to_pylist()]
    codes = coded.indices.to_numpy(zero_copy_only=False)
    size = np.array([len(k) for k in known], np.int64)
    all_ids = pa.array([i for k in known for i in k], pa.int32())
    place, token = ranges((np.cumsum(size) - size)[codes], size[codes])
    first = np.cumsum(size[codes]) - size[codes]
    row = np.repeat(np.arange(len(lists)), length)
    tokens_before = np.cumsum(length) - length
    n_ids = np.bincount(row[token], minlength=len(lists))
    ids_before = np.cumsum(n_ids) - n_ids

    def listed(count, values):
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(count)]), pa.int32()), values, mask=none)

    return [
        listed(n_ids, all_ids.take(pa.array(place, pa.int64()))),
        listed(n_ids, pa.array(token - tokens_before[row[token]], pa.int32())),
        listed(length, pa.array(first - ids_before[row], pa.int32())),
    ]


def places_of_tokens(places: str, length: str = "size(ids)") -> str:
    """SQL text: places of all ids of the tokens at `places`, in order; needs `first_of`. Others are ignored."""
    last = f"coalesce(get(first_of, i + 1), {length}) - 1"
    return (
        f"flatten(transform(filter(array_sort(array_distinct({places})), i -> i >= 0 and i < size(first_of)),"
        f" i -> if({last} < first_of[i], cast(array() as array<int>), sequence(first_of[i], {last}))))"
    )


def tokens_of_places(places: str) -> str:
    """SQL text: places of the tokens that the ids at `places` belong to, in order; needs `token_of`."""
    known = f"filter({places}, p -> p >= 0 and p < size(token_of))"
    return f"array_sort(array_distinct(transform({known}, p -> token_of[p])))"


def split_unknown(df: DataFrame, ids: str):
    """(good, quarantine): sequences with a token that has no id get a reason code."""
    unknown = f"exists({ids}, i -> i is null)"
    return keep_rows(df, f"not {unknown}"), keep_rows(df, unknown).withColumn("reason", F.lit("unknown_token"))


def lookup_tokens(df: DataFrame, ids: str, vocab: DataFrame, number_tokens: DataFrame | None = None) -> DataFrame:
    """ids -> `tokens` (array<string>), `<UNK:id>` where an id has no token.

    The id lookup is one array literal over the id range of the vocabulary.
    """
    rows = vocab.select("token", "id").limit(VOCAB_LIMIT + 1).collect()
    more = [] if number_tokens is None else number_tokens.select("token", "id").limit(VOCAB_LIMIT + 1).collect()
    if max(len(rows), len(more)) > VOCAB_LIMIT:
        raise ValueError(f"vocabulary has more than {VOCAB_LIMIT} tokens")
    rows += more
    by_id = {int(r["id"]): r["token"] for r in rows}
    low, high = min(by_id), max(by_id)
    dense = [i for i in range(low, high + 1) if i in by_id] if high - low <= 4 * len(by_id) else None
    if dense is not None:
        names = ", ".join(f"'{by_id[i]}'" if i in by_id else "cast(null as string)" for i in range(low, high + 1))
        name = f"get(array({names}), cast(i - {low} as int))"
    else:
        name = "try_element_at(map(" + ", ".join(f"{i}, '{t}'" for i, t in by_id.items()) + "), cast(i as int))"
    return df.withColumn(
        "tokens", F.expr(f"transform({ids}, i -> coalesce({name}, concat('<UNK:', cast(i as string), '>')))")
    )
