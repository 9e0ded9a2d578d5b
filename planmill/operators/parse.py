"""Token sequences -> plans.

A sequence is first mapped to a string with one class letter per token, so a letter's place is
the token's index. Blocks are then regular-expression matches that tile that string, and every
rule about a single token (a vertex, a stray token) is a look at its neighbours. There is no
shuffle. Answers are read in Arrow batches, by the strict and the tolerant grammar; conditions in projections.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planmill.constants import MAX_COORD
from planmill.functions.arrays import let
from planmill.operators.strict import DOOR, LETTERS, counted, parsed
from planmill.operators.tolerant import plan_of


def letters(tokens: str) -> str:
    """SQL text: array of class letters."""
    words = ", ".join(f"'{t}', '{c}'" for t, c in LETTERS.items())
    number = "try_cast(substring(t, 4, length(t) - 4) as int) is not null"
    return (
        f"transform({tokens}, t -> case"
        f" when startswith(t, '<X:') and {number} then 'x'"
        f" when startswith(t, '<Y:') and {number} then 'y'"
        f" when startswith(t, '<TYPE:') then 't' when startswith(t, '<RID:') then 'i'"
        f" when startswith(t, '<REL:') then 'l' else coalesce(try_element_at(map({words}), t), '?') end)"
    )


def _int(token):
    return f"cast(substring({token}, 4, length({token}) - 4) as int)"


def _clamped(token):
    return f"greatest(0, least({MAX_COORD}, {_int(token)}))"


def _tiles(text, pattern, offset):
    """SQL text: array of (s, st, n) structs for matches that tile `text` from index `offset`."""
    found = f"regexp_extract_all({text}, '{pattern}', 0)"
    step = (
        f"aggregate({found}, named_struct('at', {offset}, 'out', cast(array() as array<struct<s:string,st:int,n:int>>)),"
        f" (a, b) -> named_struct('at', a.at + length(b), 'out',"
        f" concat(a.out, array(named_struct('s', b, 'st', a.at, 'n', length(b))))), a -> a.out)"
    )
    return step


def _range(first, last):
    """SQL text: ints first..last, empty when last < first."""
    return f"if({last} < {first}, cast(array() as array<int>), sequence({first}, {last}))"


def cut_at_stop(df: DataFrame, tokens: str, stops: list[str]) -> DataFrame:
    """Keep what comes before the first stop token."""
    ends = ", ".join(f"nullif(array_position({tokens}, '{t}'), 0)" for t in stops)
    first = f"least({ends})" if len(stops) > 1 else ends
    return df.withColumn(
        tokens, F.expr(f"slice({tokens}, 1, cast(coalesce({first} - 1, size({tokens})) as int))")
    )


def parse_strict(df: DataFrame, tokens: str = "tokens", length: str | None = None) -> DataFrame:
    """`parsed`: level, success, front_door, rooms with token indices, doors and error indices; see `strict`.

    level 0: no <OUTPUT>; 1: no room; 2: rooms with errors; 3: rooms and no error. Error indices
    are distinct, sorted and 0-based; a missing closing token is marked at the next index.
    `length` names a column of the number of tokens, for jobs that need it and not the tokens.
    """
    if length is None:
        return df.withColumn("parsed", parsed(F.col(tokens)))
    both = df.withColumn("_counted", counted(F.col(tokens)))
    return both.withColumns({"parsed": F.col("_counted.parsed"), length: F.col("_counted.n_tokens")}).drop("_counted")


def _coords(tokens, s="b.s", st="b.st"):
    """Clamped numbers of the x / y letters of a block."""
    return (
        f"transform(filter({_range(st, f'{st} + length({s}) - 1')}, p -> _c[p] in ('x', 'y')), p -> {_clamped(tokens + '[p]')})"
    )


def _last_word(tokens, letter, prefix, s="b.s", st="b.st"):
    """Text of the last token of a class in a block; null when there is none."""
    hits = f"filter({_range(st, f'{st} + length({s}) - 1')}, p -> _c[p] = '{letter}')"
    word = f"substring({tokens}[p], {prefix + 1}, length({tokens}[p]) - {prefix + 1})"
    return let(hits, "hs", let("get(hs, size(hs) - 1)", "p", f"if(p is null, cast(null as string), {word})"))


def _door_of(values):
    return let(
        values, "vs",
        f"if(size(vs) < 4, cast(null as {DOOR}), named_struct('x', vs[0], 'y', vs[1], 'w', vs[2], 'h', vs[3]))",
    )


def _front(tokens):
    """The last closed front-door block decides."""
    closed = "filter(_b, b -> startswith(b.s, 'F') and endswith(b.s, 'd'))"
    doors = (
        f"transform({closed}, b -> if(contains(b.s, 'n'), cast(null as {DOOR}), {_door_of(_coords(tokens))}))"
    )
    return f"get({doors}, size({closed}) - 1)"


def parse_answer(df: DataFrame, tokens: str = "tokens") -> DataFrame:
    """`plan`: tolerant reading of an answer; null without <OUTPUT> or without a closed room.

    Rooms are numbered in order, a missing type is 'unknown', coordinates are clamped, doors with
    fewer than four numbers are left out, and doors become edges with the dummy pair [0, 0]; see `tolerant`.
    """
    return df.withColumn("plan", plan_of(F.col(tokens)))


def parse_condition(df: DataFrame, tokens: str = "tokens") -> DataFrame:
    """`plan`: tolerant reading of a condition; null without <INPUT>. The summary is ignored."""
    staged = (
        df.withColumn("_c", F.expr(letters(tokens)))
        .withColumn("_s", F.expr("array_join(_c, '')"))
        .withColumn("_o", F.expr("instr(_s, 'I')"))
        .withColumn(
            "_b",
            F.expr(
                _tiles(
                    "regexp_extract(substring(_s, _o + 1), '^[^J]*', 0)",
                    "S[^z]*(?:z|$)|F[^d]*(?:d|$)|R[^r]*(?:r|$)|G[^g]*(?:g|$)|P[^p]*(?:p|$)|[^SFRGP]+", "_o",
                )
            ),
        )
    )

    def closed(a, z):
        return f"filter(_b, b -> startswith(b.s, '{a}') and endswith(b.s, '{z}'))"

    rooms = (
        f"transform({closed('R', 'r')}, (b, i) -> named_struct("
        f"'rid', coalesce(cast({_last_word(tokens, 'i', 5)} as int), i),"
        f" 'type', coalesce({_last_word(tokens, 't', 6)}, 'unknown'), 'coords', {_coords(tokens)}))"
    )
    parts = _tiles("substring(b.s, 2, b.n - 2)", "D[^d]*(?:d|$)|[^D]+", "b.st + 1")
    number = f"cast({_last_word(tokens, 'i', 5, 'q.s', 'q.st')} as int)"
    numbers = f"filter(transform(filter({parts}, q -> not startswith(q.s, 'D')), q -> {number}), v -> v is not null)"
    doors = (
        f"filter(transform(filter({parts}, q -> startswith(q.s, 'D') and endswith(q.s, 'd')),"
        f" q -> {_door_of(_coords(tokens, 'q.s', 'q.st'))}), d -> d is not null)"
    )
    edges = (
        f"transform({closed('G', 'g')}, b -> named_struct('rid', get({numbers}, size({numbers}) - 1), 'doors', {doors}))"
    )
    rids = f"filter({_range('b.st', 'b.st + b.n - 1')}, p -> _c[p] = 'i')"
    rel = _last_word(tokens, "l", 5)
    rid = lambda k: f"cast(substring({tokens}[{rids}[{k}]], 6, length({tokens}[{rids}[{k}]]) - 6) as int)"
    spatial = (
        f"transform(filter({closed('P', 'p')}, b -> size({rids}) >= 2 and {rel} is not null),"
        f" b -> named_struct('rid_a', {rid(0)}, 'rid_b', {rid(1)}, 'direction', {rel}))"
    )
    return staged.withColumn(
        "plan",
        F.expr(
            f"if(_o = 0, null, named_struct('rooms', {rooms}, 'edges', {edges}, 'front_door', {_front(tokens)}, 'spatial', {spatial}))"
        ),
    ).drop("_c", "_s", "_o", "_b")


def run_counters(df: DataFrame, keys: list[str], plan: str = "plan") -> DataFrame:
    """Parsed and failed outputs per run."""
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_outputs"),
        F.count_if(F.col(plan).isNotNull()).alias("n_parsed"),
        F.count_if(F.col(plan).isNull()).alias("n_failed"),
    )
