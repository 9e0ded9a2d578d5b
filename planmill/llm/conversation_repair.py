"""Operator 12, conversation structure repair: faults of turns and the cheapest edits to a role grammar.

Two passes, neither of which gathers a conversation. The first sorts small facts (no texts) of all turns
by conversation and turn over range partitions, so that a conversation of any size lies in neighbouring
tasks, and runs the parser over pieces of at most PIECE turns from every stack it can be entered with.
The second streams each conversation's pieces, which give its audit, and behind them its turns.
"""

import hashlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from planmill.llm.glr_repair import INSERT, KEEP, MUST_DELETE, Chain, shared_repair
from planmill.llm.segments import in_parts

PIECE = 1024
BLANKS = " \t\n\x0b\x0c\r"
STOPS = ".!?"
ROLE_NAMES = {"u": "user", "a": "assistant"}


def damage(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) of a table of turns after seeded damage; null role or text: one space.

    crc32 of `conv_id:turn` (nulls as one space) modulo 20 decides: 0 drops the turn, 1 empties its text,
    2 removes its full stops, exclamation and question marks, 3 repeats it, 4 makes its role user.
    """
    part = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(part("conv_id"), F.lit(":"), part("turn")).cast("binary")) % 20
    marked = conversations.select("conv_id", "turn", part("role").alias("role"), part("text").alias("text"), kind.alias("kind"))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", STOPS, "")).otherwise(F.col("text"))
    copies = F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return marked.filter("kind <> 0").select(
        "conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"),
        F.explode(copies).alias("copy"),
    ).drop("copy")


def _turns(conversations: DataFrame) -> DataFrame:
    return conversations.select(
        "conv_id", F.col("turn").cast("long").alias("turn"),
        *[F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")],
    ).withColumn("digest", F.sha2("text", 256))


def _symbol() -> Column:
    """The parser's symbol of a turn that repeats none before it."""
    body = F.rtrim(F.col("text"), F.lit(BLANKS))
    initial = F.left("role", F.lit(1))
    plain = F.when(initial.isin("s", "u", "a"), initial).otherwise("x")
    return (
        F.when(body == "", MUST_DELETE)
        .when(F.right(body, F.lit(1)).isin(*STOPS), plain)
        .otherwise(F.upper(plain))
    )


def _facts(turns: DataFrame, also: DataFrame | None) -> DataFrame:
    """(conv_id, turn, role, digest, n, first, symbol): one row for equal turns, in no order.

    `first` is 1 where one of the n turns is the first of its role and text in the conversation.
    """
    none = lambda kind: F.lit(None).cast(kind)
    rows = turns.select("conv_id", "turn", "role", "digest", F.lit(1).alias("n"), F.lit(0).alias("first"), _symbol().alias("symbol"))
    lowest = turns.groupBy("conv_id", "role", "digest").agg(
        F.min(F.struct(F.col("turn").isNotNull().alias("known"), "turn")).alias("at")
    )
    marks = lowest.select(
        "conv_id", "at.turn", "role", "digest", F.lit(0).alias("n"), F.lit(1).alias("first"), none("string").alias("symbol")
    )
    both = rows.unionByName(marks)
    if also is not None:
        both = both.unionByName(
            also.select(
                "conv_id", none("long").alias("turn"), none("string").alias("role"), none("string").alias("digest"),
                F.lit(0).alias("n"), F.lit(0).alias("first"), none("string").alias("symbol"),
            ).distinct()
        )
    return both.groupBy("conv_id", "turn", "role", "digest").agg(
        F.sum("n").alias("n"), F.max("first").alias("first"), F.max("symbol").alias("symbol")
    )


_PIECE_FIELDS = (
    "part int, piece int, size long, first_turn long, last_turn long, n_turns long, blank long, duplicate long, truncated long,"
    " illegal long, opens string, closes string, ways array<struct<entry: int, exit: int, cost: long, audit: string>>"
)


class _Piece:
    """Facts of at most PIECE neighbouring turns of one conversation."""

    def __init__(self):
        self.symbols: list[str] = []
        self.size = self.n_turns = self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.first_turn = self.last_turn = None
        self.opens = self.closes = ""

    def add(self, turn, initial, symbol, n, first):
        """n equal turns; all but the first of them, or all, repeat an earlier one."""
        if turn is not None and turn != self.last_turn:
            self.first_turn = turn if self.first_turn is None else self.first_turn
            self.last_turn, self.n_turns = turn, self.n_turns + 1
        if self.size:
            self.illegal += self.closes + initial not in _LEGAL
        else:
            self.opens = initial
        self.closes = initial
        self.illegal += n - 1
        self.size += n
        if symbol == MUST_DELETE:
            self.blank += n
            self.symbols.append(MUST_DELETE * n)
            return
        self.duplicate += n - first
        self.truncated += first and symbol.isupper()
        self.symbols.append(symbol * first + MUST_DELETE * (n - first))

    def row(self, conv_id, part, piece, repair, entries):
        symbols = "".join(self.symbols)
        ways = [
            {"entry": e, "exit": x, "cost": cost, "audit": audit}
            for e in entries
            for x, cost, audit in repair.passage(symbols, e)
        ]
        return (
            conv_id, part, piece, self.size, self.first_turn, self.last_turn, self.n_turns, self.blank, self.duplicate,
            self.truncated, self.illegal, self.opens, self.closes, ways,
        )


_LEGAL = {"su", "ua", "au"}


def _pieces(facts: DataFrame) -> DataFrame:
    """Pieces of conversations with the parser's passages; (part, piece) orders those of one conversation."""
    kind = facts.schema["conv_id"].dataType.simpleString()
    ordered = facts.withColumn("initial", F.left("role", F.lit(1))).orderBy("conv_id", "turn", "role", "digest")

    schema = to_arrow_schema(StructType.fromDDL(f"conv_id {kind}, {_PIECE_FIELDS}"))

    def rows(batches):
        repair = shared_repair()
        part = TaskContext.get().partitionId()
        everywhere = range(len(repair.stacks))
        conv, piece, number, at_start, out = None, None, 0, False, []

        def close():
            # Where another conversation lies in front, this one begins here, with an empty stack.
            entries = [0] if at_start and not number else everywhere
            out.append(piece.row(conv, part, number, repair, entries))

        def batch():
            columns = [pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)]
            out.clear()
            return pa.RecordBatch.from_arrays(columns, schema=schema)

        for own in in_parts(batches, 4096):
            for conv_id, turn, n, first, symbol, initial in zip(*(c.to_pylist() for c in own.columns), strict=True):
                if piece is None or conv_id != conv:
                    if piece is not None:
                        close()
                    at_start = piece is not None
                    conv, piece, number = conv_id, _Piece(), 0
                while n:
                    if piece.size >= PIECE:
                        close()
                        piece, number = _Piece(), number + 1
                    here = min(n, PIECE - piece.size)
                    piece.add(turn, initial, symbol, here, first)
                    n, first = n - here, 0
                if len(out) >= 256:
                    yield batch()
        if piece is not None:
            close()
            yield batch()

    columns = ordered.select("conv_id", "turn", "n", "first", "symbol", "initial")
    return columns.mapInArrow(rows, f"conv_id {kind}, {_PIECE_FIELDS}")


class _Walk:
    """One conversation as it streams by: its pieces, then its turns in the same order."""

    def __init__(self, conv_id):
        self.conv_id, self.repair = conv_id, shared_repair()
        self.chain, self.audit = Chain(self.repair), None
        self.size = self.blank = self.duplicate = self.truncated = self.illegal = self.n_turns = 0
        self.first_turn = self.last_turn = None
        self.closes = ""
        self.node, self.at, self.position = self.repair.start, 0, 0
        self.hash = hashlib.sha256()

    def piece(self, p):
        if p["size"] and self.size:
            self.illegal += self.closes + p["opens"] not in _LEGAL
        if p["size"]:
            self.closes = p["closes"]
        if p["first_turn"] is not None:
            self.n_turns += p["n_turns"] - (p["first_turn"] == self.last_turn)
            self.first_turn = p["first_turn"] if self.first_turn is None else self.first_turn
            self.last_turn = p["last_turn"]
        for name in ("size", "blank", "duplicate", "truncated", "illegal"):
            setattr(self, name, getattr(self, name) + p[name])
        self.chain.add([(w["entry"], w["exit"], w["cost"], w["audit"]) for w in p["ways"]])

    def settle(self):
        if self.audit is None:
            self.cost, self.audit = self.chain.finish()

    def _write(self, turn, role, text, edit):
        line = f"{role}:{text}"
        self.hash.update((line if not self.position else "\n" + line).encode("utf-8"))
        self.position += 1
        return self.conv_id, self.position, turn, role, text, edit

    def inserts(self):
        self.settle()
        while self.at < len(self.audit) and self.audit[self.at] == INSERT:
            self.node, terminal = self.repair.replay(self.node, INSERT, None)
            self.at += 1
            yield self._write(None, ROLE_NAMES[terminal], "", INSERT)

    def turn(self, turn, role, text):
        """Repaired turns up to and with this one."""
        yield from self.inserts()
        edit = self.audit[self.at]
        self.at += 1
        self.node, terminal = self.repair.replay(self.node, edit, role[:1])
        if terminal:
            yield self._write(turn, role if edit == KEEP else ROLE_NAMES[terminal], text, edit)

    def summary(self):
        gaps = 0 if self.first_turn is None else self.last_turn - self.first_turn + 1 - self.n_turns
        return (
            self.conv_id, gaps, self.blank, self.duplicate, self.truncated, self.illegal, self.cost, self.audit,
            self.hash.hexdigest(),
        )


SUMMARY = (
    "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
)
REPAIRED = "position long, turn long, role string, text string, edit string"


def _walked(conversations: DataFrame, also: DataFrame | None, with_turns: bool) -> DataFrame:
    turns = _turns(conversations)
    pieces = _pieces(_facts(turns, also))
    own = [c for c in pieces.columns if c not in ("conv_id", "part", "piece")]
    headers = pieces.select("conv_id", F.lit(0).alias("kind"), "part", "piece", F.struct(*own).alias("p"))
    bodies = turns.select("conv_id", F.lit(1).alias("kind"), "turn", "role", "digest", "text")
    stream = (
        headers.unionByName(bodies, allowMissingColumns=True)
        .repartition("conv_id")
        .sortWithinPartitions("conv_id", "kind", "part", "piece", "turn", "role", "digest")
        .select("conv_id", "kind", "p", "turn", "role", "text")
    )
    kind = conversations.schema["conv_id"].dataType.simpleString()
    fields = f"conv_id {kind}, {REPAIRED if with_turns else SUMMARY}"
    schema = to_arrow_schema(StructType.fromDDL(fields))

    def rows(batches):
        walk, out = None, []

        def leave():
            last = list(walk.inserts())
            out.extend(last if with_turns else [walk.summary()])

        def batch():
            columns = [pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)]
            out.clear()
            return pa.RecordBatch.from_arrays(columns, schema=schema)

        for part in in_parts(batches, 512):
            for conv_id, row, p, turn, role, text in zip(*(c.to_pylist() for c in part.columns), strict=True):
                if walk is None or conv_id != walk.conv_id:
                    if walk is not None:
                        leave()
                    walk = _Walk(conv_id)
                if row == 0:
                    walk.piece(p)
                else:
                    made = list(walk.turn(turn, role, text))
                    if with_turns:
                        out.extend(made)
            if len(out) >= 256:
                yield batch()
        if walk is not None:
            leave()
        if out:
            yield batch()

    return stream.mapInArrow(rows, fields)


def summaries(conversations: DataFrame, also: DataFrame | None = None) -> DataFrame:
    """One row for each conv_id: faults, the cheapest repair and the hash of the repaired conversation.

    The turns of a conversation are taken by turn (nulls first; equal turns by role, then by the SHA-256 of
    the text). A turn's first fault counts: `blank` (no character but white space), `duplicate` (role and text
    of an earlier one), `truncated` (the last such character is no full stop, exclamation or question mark).
    `gaps`: missing turn numbers; `illegal`: neighbours whose role initials are not su, ua or au. `cost` and
    `audit`: the cheapest edits (of equal ones the ASCII-least audit) that leave no turn, or a system turn or
    none and then pairs of user and assistant: keep 0, rerole 1, delete 2 (a must for blank and duplicate
    turns), insert 5; a truncated turn that stays adds 5. `repaired_sha256`: of the repaired `role:text` lines.

    Null roles and texts count as one space; a null conv_id is a conversation of its own; a null turn comes
    first and is no gap. Repeated rows are duplicates. `also` lists conv_ids that are reported even without a
    turn: zeros, empty audit, hash of an empty string. An empty table gives those only. Other columns are not read.

    A conversation of any size is parsed in pieces over many tasks. Its audit is one string, and its hash, which
    by definition takes one byte after the other, is made by one task that streams its turns and keeps none.
    """
    return _walked(conversations, also, False)


def repaired(conversations: DataFrame) -> DataFrame:
    """(conv_id, position from 1, turn, role, text, edit) of the repaired turns; cases as in `summaries`.

    Inserted turns have a null turn and empty text.
    """
    return _walked(conversations, None, True)
