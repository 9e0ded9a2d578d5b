"""Conversation repair against exhaustive search and a plain walk over each conversation."""

import hashlib
import itertools
import random
import re
import zlib

import pytest

from planmill.llm import conversation_repair as cr
from planmill.llm import queries
from planmill.llm.glr_repair import ROLE_GRAMMAR, Chain, Repair

rng = random.Random(12)
FIELDS = "conv_id long, turn long, role string, text string, copy int, n string, p double, symbol boolean"


def cheapest(symbols):
    """Least (cost, audit, terminals) over all ways to edit a short row of symbols."""
    best = None
    options = []
    for s in symbols:
        own = [("D", "", 2)]
        if s != "d":
            more = 5 if s.isupper() else 0
            own += [("K", s.lower(), more), ("R", "u", 1 + more), ("R", "a", 1 + more)]
        options.append(own)
    for gaps in itertools.product(["", "u", "a", "ua", "au"], repeat=len(symbols) + 1):
        if best and 5 * sum(map(len, gaps)) > best[0]:
            continue
        for choice in itertools.product(*options):
            terminals, audit = gaps[0], "I" * len(gaps[0])
            for (letter, terminal, _), gap in zip(choice, gaps[1:], strict=True):
                terminals += terminal + gap
                audit += letter + "I" * len(gap)
            if re.fullmatch("(s?(ua)+)?", terminals):
                cost = 5 * sum(map(len, gaps)) + sum(c for _, _, c in choice)
                best = min(best or (cost, audit, terminals), (cost, audit, terminals))
    return best


@pytest.fixture(scope="module")
def repair():
    return Repair()


def by_pieces(repair, symbols, size):
    chain = Chain(repair)
    for at in range(0, len(symbols), size):
        own = symbols[at : at + size]
        chain.add([(e, *way) for e in range(len(repair.stacks)) for way in repair.passage(own, e)])
    return chain.finish()


def test_least_edits_of_all_short_rows(repair):
    for symbols in map("".join, [*itertools.product("suaxSUd", repeat=2), *itertools.product("suaAd", repeat=3), "x", ""]):
        want = cheapest(symbols)
        for size in (1, 2, 9):
            assert by_pieces(repair, symbols, size) == want[:2], symbols
        letters = repair.roles(want[1], symbols.lower())
        assert "".join(t for _, t in letters) == want[2]


def test_pieces_change_nothing(repair):
    for _ in range(300):
        symbols = "".join(rng.choice("suaxSUAXd") for _ in range(rng.randrange(80)))
        assert by_pieces(repair, symbols, 3) == by_pieces(repair, symbols, 11) == by_pieces(repair, symbols, 1000)


def test_grammars_need_bounded_stacks():
    with pytest.raises(ValueError, match="left-recursive"):
        Repair((("C", ()), ("C", ("T",)), ("T", ("u", "a")), ("T", ("u", "a", "T"))))
    assert Repair(ROLE_GRAMMAR).passage("ua", 0)


def plain(rows, solve):
    """The contract, said plainly, for one conversation's damaged (turn, role, text) rows."""
    rows = sorted(
        [(t, " " if r is None else r, " " if x is None else x) for t, r, x in rows],
        key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).hexdigest()),
    )
    seen, symbols, faults = set(), "", {"blank": 0, "duplicate": 0, "truncated": 0}
    for _, role, text in rows:
        body = re.sub(r"[ \t-\r]+$", "", text)
        fault = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else ""
        seen.add((role, text))
        if fault:
            faults[fault] += 1
        symbol = role[:1] if role[:1] in ("s", "u", "a") else "x"
        symbols += "d" if fault in ("blank", "duplicate") else symbol.upper() if fault else symbol
    known = {t for t, _, _ in rows if t is not None}
    gaps = max(known) - min(known) + 1 - len(known) if known else 0
    pairs = zip(rows, rows[1:], strict=False)
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in pairs)
    cost, audit, terminals = solve(symbols)
    lines, left, ends = [], iter(rows), iter(terminals)
    for letter in audit:
        row = None if letter == "I" else next(left)
        if letter == "D":
            continue
        terminal = next(ends)
        name = {"u": "user", "a": "assistant"}.get(terminal)
        lines.append(f"{row[1]}:{row[2]}" if letter == "K" else f"{name}:{row[2] if row else ''}")
    digest = hashlib.sha256("\n".join(lines).encode()).hexdigest()
    return gaps, faults["blank"], faults["duplicate"], faults["truncated"], illegal, cost, audit, digest, lines


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        kind = zlib.crc32(key.encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind == 1:
            text = ""
        if kind == 2:
            text = re.sub("[.!?]", "", text)
        if kind == 4:
            role = "user"
        out.extend([(conv, turn, role, text)] * {0: 0, 3: 2}.get(kind, 1))
    return out


def table(spark, rows):
    return spark.createDataFrame([(*r, 1, "n", 0.5, True) for r in rows], FIELDS)


ROLES = ["system", "user", "assistant", "assistant", "user", None, "", "tool", "umpire"]
WORDS = ["Yes.", "No!", "cut off", " ", "", None, "Why?\n", "\t\x0b", "é.", "same.", "." * 3000]
ROWS = [
    (conv, turn if rng.random() < 0.9 else rng.choice([None, 2]), rng.choice(ROLES), rng.choice(WORDS))
    for conv in [None, *range(60)]
    for turn in range(rng.randrange(1, 5))
]
LONG = [(900, t, ["user", "assistant"][t % 2], rng.choice(WORDS) or "x") for t in range(700)]
COPIES = [(901, 5, "user", "again.")] * 500


def solver(repair):
    def solve(symbols):
        cost, audit = by_pieces(repair, symbols, 4096)
        return cost, audit, "".join(t for _, t in repair.roles(audit, symbols.lower()))

    return solve


@pytest.mark.parametrize("piece", [3, 1024])
def test_whole_tables(spark, repair, monkeypatch, tmp_path, piece):
    monkeypatch.setattr(cr, "PIECE", piece)
    rows = ROWS + LONG + COPIES
    table(spark, rows).repartition(5).write.parquet(f"{tmp_path}/conversations.parquet")
    want, by_conv = {}, {r[0]: [] for r in rows}
    for conv, *row in damaged(rows):
        by_conv[conv].append(row)
    for conv, own in by_conv.items():
        want[conv] = plain(own, solver(repair))
        if len(own) <= 3:
            assert want[conv] == plain(own, cheapest)
    got = queries.op12_conversation_repair(spark, str(tmp_path))
    assert got.columns[1:] == ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert {r.conv_id: tuple(r)[1:] for r in got.collect()} == {c: w[:-1] for c, w in want.items()}
    turns = cr.repaired(cr.damage(table(spark, rows))).orderBy("conv_id", "position").collect()
    lines = {c: [] for c in by_conv}
    for r in turns:
        lines[r.conv_id].append(f"{r.role}:{r.text}")
        assert r.position == len(lines[r.conv_id])
    assert lines == {c: w[-1] for c, w in want.items()}


def test_conversations_over_many_tasks(spark, repair):
    """A conversation that range partitioning cuts is parsed as one."""
    rows = [(1, t, rng.choice(["user", "assistant", "system"]), f"text {t}" + rng.choice(["", "."])) for t in range(900)]
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        parts = {r.part for r in cr._pieces(cr._facts(cr._turns(table(spark, rows)), None)).collect()}
        got = cr.summaries(table(spark, rows)).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    assert len(parts) > 2 and len(got) == 1
    assert tuple(got[0])[1:] == plain([r[1:] for r in rows], solver(repair))[:-1]


def test_no_rows(spark):
    empty = table(spark, [])
    assert cr.summaries(empty).collect() == [] and cr.repaired(empty).collect() == []
    only = cr.summaries(empty, also=table(spark, [(7, 1, "user", "x."), (7, 2, "user", "y."), (None, 1, "", "")]))
    nothing = hashlib.sha256(b"").hexdigest()
    assert sorted(map(str, (tuple(r) for r in only.collect()))) == sorted(
        map(str, [(7, 0, 0, 0, 0, 0, 0, "", nothing), (None, 0, 0, 0, 0, 0, 0, "", nothing)])
    )
