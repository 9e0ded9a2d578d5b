"""Least-cost repair of symbol rows by a generalised LR parser.

The parser keeps a graph-structured stack: stacks are linked nodes that share what lies below, and the
frontier holds one node for each stack top. For every symbol it may insert terminals, then keep, rerole
or delete the symbol. Where two ways lead to equal tops, the one of smaller (cost, audit) stays. That
loses nothing here: two stacks of the role grammar with equal tops differ only in what lies at the
bottom, and every way to go on from one is a way to go on from the other.

Audits are compared letter by letter. An insert counts to the symbol behind it, so audits of ways that
have used the same symbols end in a letter for a symbol and none is a beginning of another: their
order never changes with what follows. So a step depends only on the stacks, their costs above the
cheapest, and the order of their audits. Steps are kept in a table, and a row of symbols costs a lookup
a symbol and a walk back.

A top dearer than the cheapest by more than SLACK is left out: the cheapest one can do all that it does,
with two inserts to come to a stack with the same future and one delete in place of a kept system turn.
So costs above the cheapest are bounded, and with them the steps.
"""

import heapq
from functools import lru_cache

KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
COST = {KEEP: 0, REROLE: 1, DELETE: 2, INSERT: 5}
TRUNCATED_COST = 5
#: Terminals: s, u and a. An empty row of turns, or a system turn or none and then pairs of user and assistant.
ROLE_GRAMMAR = (("C", ()), ("C", ("T",)), ("C", ("s", "T")), ("T", ("u", "a")), ("T", ("T", "u", "a")))
REROLES = ("u", "a")
#: A symbol is a terminal (or x for any other role), in upper case if truncated; d must be deleted.
MUST_DELETE = "d"
_END = "$"
SLACK = 2 * COST[INSERT] + COST[DELETE]
_MOST_STACKS = 64
#: Steps kept at a time; forgotten ones are worked out again.
_KNOWN_STEPS = 50_000


class Tables:
    """Shifts, gotos and reductions (where the next terminal allows them) of a grammar's item sets."""

    def __init__(self, grammar):
        self.rules = [("", (grammar[0][0],)), *grammar]
        heads = {h for h, _ in self.rules}
        self.terminals = {x for _, body in self.rules for x in body} - heads
        follow = self._follow(heads)
        first = self._closure({(0, 0)})
        numbers, todo = {first: 0}, [first]
        self.moves: list[dict] = []
        self.reductions: list[list] = []
        while todo:
            items = todo.pop(0)
            kernels: dict = {}
            done = []
            for rule, dot in sorted(items):
                head, body = self.rules[rule]
                if dot == len(body):
                    done.append((rule, follow[head]))
                else:
                    kernels.setdefault(body[dot], set()).add((rule, dot + 1))
            moves = {}
            for symbol, kernel in sorted(kernels.items()):
                own = self._closure(kernel)
                if own not in numbers:
                    numbers[own] = len(numbers)
                    todo.append(own)
                moves[symbol] = numbers[own]
            self.moves.append(moves)
            self.reductions.append(done)

    def _closure(self, items):
        items, todo = set(items), list(items)
        while todo:
            rule, dot = todo.pop()
            for symbol in self.rules[rule][1][dot : dot + 1]:
                new = {(i, 0) for i, (head, _) in enumerate(self.rules) if head == symbol} - items
                items |= new
                todo.extend(new)
        return frozenset(items)

    def _follow(self, heads):
        empty = {h for h, body in self.rules if not body}
        opens: dict = {h: set() for h in heads}
        follow: dict = {h: set() for h in heads}
        follow[""].add(_END)
        for _ in range(len(self.rules) * len(self.rules)):
            for head, body in self.rules:
                if all(x in empty for x in body):
                    empty.add(head)
                behind = set(follow[head])
                for x in reversed(body):
                    if x in heads:
                        follow[x] |= behind
                        behind = opens[x] | (behind if x in empty else set())
                    else:
                        behind = {x}
                lead = set()
                for x in body:
                    lead |= opens[x] if x in heads else {x}
                    if x not in empty:
                        break
                opens[head] |= lead
        return follow

    @lru_cache(maxsize=None)  # noqa: B019  one object a grammar, few stacks
    def reduced(self, node, ahead):
        """All stacks that reductions allowed before terminal `ahead` make of a stack, itself included."""
        out, todo = {node}, [node]
        while todo:
            at = todo.pop()
            for rule, allowed in self.reductions[at[0]]:
                if ahead in allowed and rule:
                    head, body = self.rules[rule]
                    below = at
                    for _ in body:
                        below = below[1]
                    new = (self.moves[below[0]][head], below)
                    if new not in out:
                        out.add(new)
                        todo.append(new)
        return out

    @lru_cache(maxsize=None)  # noqa: B019
    def shifted(self, node, terminal):
        """Stacks after a terminal; a state that can only reduce one rule does so at once."""
        out = []
        for at in self.reduced(node, terminal):
            to = self.moves[at[0]].get(terminal)
            if to is not None:
                own = (to, at)
                while not self.moves[own[0]] and len(self.reductions[own[0]]) == 1:
                    head, body = self.rules[self.reductions[own[0]][0][0]]
                    below = own
                    for _ in body:
                        below = below[1]
                    own = (self.moves[below[0]][head], below)
                out.append(own)
        return tuple(sorted(out, key=repr))

    @lru_cache(maxsize=None)  # noqa: B019
    def accepts(self, node):
        return any(rule == 0 for at in self.reduced(node, _END) for rule, _ in self.reductions[at[0]])


class Repair:
    """Repairs under a role grammar; `stacks` are all stacks that can stand between two symbols."""

    def __init__(self, grammar=ROLE_GRAMMAR):
        self.tables = Tables(grammar)
        self.start = (0, None)
        self.stacks = [self.start]
        for node in self.stacks:
            for t in sorted(self.tables.terminals):
                self.stacks.extend(n for n in self.tables.shifted(node, t) if n not in self.stacks)
            if len(self.stacks) > _MOST_STACKS:
                raise ValueError("the stacks of this grammar have no bound; write its lists left-recursive")
        self.number = {node: i for i, node in enumerate(self.stacks)}
        self._steps: dict = {}
        self._ends: dict = {}

    def _inserted(self, frontier):
        """The frontier and all tops that inserts reach, as {top: (cost, (place in the order, letters), node)}."""
        best = {node[0]: (cost, (at, ""), node) for at, (node, cost) in enumerate(frontier)}
        todo = list(best.values())
        heapq.heapify(todo)
        while todo:
            cost, (at, letters), node = heapq.heappop(todo)
            if best[node[0]][:2] != (cost, (at, letters)):
                continue
            for t in REROLES:
                for own in self.tables.shifted(node, t):
                    new = (cost + COST[INSERT], (at, letters + INSERT), own)
                    if own[0] not in best or new[:2] < best[own[0]][:2]:
                        best[own[0]] = new
                        heapq.heappush(todo, new)
        return best

    def step(self, frontier, symbol):
        """(next frontier, cost of its cheapest, where each came from): one symbol further.

        A frontier is a tuple of (node, cost above the cheapest) in the order of the audits; the last part
        has for each node of the next one (index in this one, letters).
        """
        known = self._steps.get((frontier, symbol))
        if known is not None:
            return known
        best: dict = {}

        def reach(node, cost, audit):
            old = best.get(node[0])
            if old is None or (cost, audit) < old[:2]:
                best[node[0]] = (cost, audit, node)

        terminal, extra = symbol.lower(), TRUNCATED_COST if symbol.isupper() else 0
        for cost, (at, letters), node in self._inserted(frontier).values():
            reach(node, cost + COST[DELETE], (at, letters + DELETE))
            if symbol == MUST_DELETE:
                continue
            for own in self.tables.shifted(node, terminal):
                reach(own, cost + COST[KEEP] + extra, (at, letters + KEEP))
            for t in REROLES:
                for own in self.tables.shifted(node, t):
                    reach(own, cost + COST[REROLE] + extra, (at, letters + REROLE))
        least = min(cost for cost, _, _ in best.values())
        ways = sorted((w for w in best.values() if w[0] <= least + SLACK), key=lambda w: w[1])
        out = (tuple((node, cost - least) for cost, _, node in ways), least, [audit for _, audit, _ in ways])
        if len(self._steps) >= _KNOWN_STEPS:
            self._steps.clear()
        self._steps[frontier, symbol] = out
        return out

    def end(self, frontier):
        """(cost, index in the frontier, trailing inserts) of the best way to a whole conversation."""
        known = self._ends.get(frontier)
        if known is None:
            ways = [(c, a) for c, a, node in self._inserted(frontier).values() if self.tables.accepts(node)]
            cost, (at, letters) = min(ways)
            known = self._ends[frontier] = (cost, at, letters)
        return known

    def passage(self, symbols: str, entry: int) -> list[tuple[int, int, str]]:
        """(exit, cost, audit) of the ways through symbols from one stack, in the order of their audits."""
        frontier = ((self.stacks[entry], 0),)
        total, path = 0, []
        for s in symbols:
            frontier, cost, came = self.step(frontier, s)
            total += cost
            path.append(came)
        out = []
        for at, (node, cost) in enumerate(frontier):
            letters = []
            for came in reversed(path):
                at, own = came[at]
                letters.append(own)
            out.append((self.number[node], total + cost, "".join(reversed(letters))))
        return out

    def roles(self, audit: str, initials) -> list[tuple[str, str]]:
        """(edit, terminal of the repaired turn or '') for each letter of an audit; `initials` of the symbols."""
        node, out, initials = self.start, [], iter(initials)
        for letter in audit:
            node, terminal = self.replay(node, letter, None if letter == INSERT else next(initials))
            out.append((letter, terminal))
        return out

    def replay(self, node, letter, initial):
        """(stack, terminal of the repaired turn) after an edit; '' where the turn is deleted."""
        if letter == DELETE:
            return node, ""
        for t in (initial,) if letter == KEEP else REROLES:
            after = self.tables.shifted(node, t)
            if after:
                return after[0], t
        raise ValueError("the audit does not fit the grammar")


class Chain:
    """Passages through neighbouring pieces of one conversation, put together as they come."""

    def __init__(self, repair: Repair):
        self.repair = repair
        self.ways = [(0, 0)]  # (stack, cost) in the order of the audits
        self.open: list[list[tuple[int, str]]] = []  # for each piece and way: (way before, audit)
        self.settled: list[str] = []

    def add(self, passages) -> None:
        """`passages`: (entry, exit, cost, audit) of one piece, for each entry in the order of its audits."""
        by_entry: dict = {}
        for entry, exit_, cost, audit in passages:
            by_entry.setdefault(entry, []).append((exit_, cost, audit))
        best: dict = {}
        for at, (stack, so_far) in enumerate(self.ways):
            for exit_, cost, audit in by_entry[stack]:
                top = self.repair.stacks[exit_][0]
                new = (so_far + cost, (at, audit), exit_)
                if top not in best or new[:2] < best[top][:2]:
                    best[top] = new
        least = min(cost for cost, _, _ in best.values())
        ways = sorted((w for w in best.values() if w[0] <= least + SLACK), key=lambda w: w[1])
        self.ways = [(exit_, cost) for cost, _, exit_ in ways]
        came = [audit for _, audit, _ in ways]
        origin = {at for at, _ in came}
        if len(origin) == 1:
            # All ways share what lies before this piece.
            self._settle(origin.pop())
            came = [(0, audit) for _, audit in came]
        self.open.append(came)

    def _settle(self, at: int) -> None:
        letters = []
        for came in reversed(self.open):
            at, audit = came[at]
            letters.append(audit)
        self.settled.extend(reversed(letters))
        self.open = []

    def finish(self) -> tuple[int, str]:
        """(cost, audit) of the whole conversation."""
        least = min(cost for _, cost in self.ways)
        frontier = tuple((self.repair.stacks[stack], cost - least) for stack, cost in self.ways)
        cost, at, letters = self.repair.end(frontier)
        self._settle(at)
        return least + cost, "".join(self.settled) + letters


@lru_cache(maxsize=1)
def shared_repair() -> Repair:
    """The repair of the role grammar, one for all tasks of a worker."""
    return Repair()
