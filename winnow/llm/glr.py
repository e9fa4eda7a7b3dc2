"""Generalised LR repair: least-cost edits that make a row of symbols a sentence of a grammar.

An SLR table drives a graph-structured stack. A node of the graph is an LR state on a node below, and
equal stacks are one node, so stacks share their lower parts. A *frontier* holds the stack tops after
some symbols, each with the least (cost, audit) of the edits that lead to it; tops that become equal
merge by that minimum. Reductions wait for the next symbol, which decides them.

Audits are compared by rank. Two audits that reach tops after the same symbol both end with what was done to
that symbol, so none is the beginning of another, and the order of two prolonged audits is that
of the audits unless these are the same. Relative costs and ranks of a frontier take few values; each step
from a frontier is worked out once and kept.
"""

from __future__ import annotations

from collections.abc import Iterable
from typing import NamedTuple

END = "$"
_KEPT_STEPS = 100_000
_MOST_NODES = 1_000


class Symbol(NamedTuple):
    """What may be done to a row: kept as a terminal (None: not), rewritten, and what staying costs besides."""

    terminal: str | None
    stays: bool
    extra: int


class Costs(NamedTuple):
    keep: int = 0
    rewrite: int = 2
    delete: int = 3
    insert: int = 2


class Tables:
    """SLR actions of a grammar given as (left side, right side) productions; the first left side is the start."""

    def __init__(self, productions: Iterable[tuple[str, tuple[str, ...]]]):
        productions = list(productions)
        self.rules = [("", (productions[0][0],)), *productions]
        self.heads = {head for head, _ in self.rules}
        follow = self._follow()
        states = [self._closure({(0, 0)})]
        self.goto: dict[tuple[int, str], int] = {}
        self.reduce: dict[tuple[int, str], list[tuple[str, int]]] = {}
        self.accept: set[int] = set()
        for state in states:
            here = states.index(state)
            for symbol in sorted({self.rules[r][1][dot] for r, dot in state if dot < len(self.rules[r][1])}):
                moved = self._closure({(r, dot + 1) for r, dot in state if self.rules[r][1][dot : dot + 1] == (symbol,)})
                if moved not in states:
                    states.append(moved)
                self.goto[here, symbol] = states.index(moved)
            for r, dot in sorted(state):
                head, body = self.rules[r]
                if dot == len(body):
                    if r == 0:
                        self.accept.add(here)
                    for terminal in sorted(follow[head]) if r else ():
                        self.reduce.setdefault((here, terminal), []).append((head, len(body)))

    def _closure(self, items: set[tuple[int, int]]) -> frozenset[tuple[int, int]]:
        items, todo = set(items), list(items)
        while todo:
            r, dot = todo.pop()
            for head in self.rules[r][1][dot : dot + 1]:
                new = {(i, 0) for i, rule in enumerate(self.rules) if rule[0] == head} - items
                items |= new
                todo += new
        return frozenset(items)

    def _follow(self) -> dict[str, set[str]]:
        first: dict[str, set[str | None]] = {head: set() for head in self.heads}
        follow: dict[str, set[str]] = {head: set() for head in self.heads}
        follow[""].add(END)

        def firsts(body: tuple[str, ...]) -> set[str | None]:
            out: set[str | None] = set()
            for symbol in body:
                own = first.get(symbol, {symbol})
                out |= own - {None}
                if None not in own:
                    return out
            return out | {None}

        while True:
            before = sum(map(len, first.values())) + sum(map(len, follow.values()))
            for head, body in self.rules:
                first[head] |= firsts(body)
                for i, symbol in enumerate(body):
                    if symbol in self.heads:
                        behind = firsts(body[i + 1 :])
                        follow[symbol] |= behind - {None}
                        follow[symbol] |= follow[head] if None in behind else set()
            if before == sum(map(len, first.values())) + sum(map(len, follow.values())):
                return follow


class Step(NamedTuple):
    """A frontier after a symbol, the cost that all its tops share, and for each top where it comes from."""

    frontier: tuple[tuple[int, int, int], ...]
    shared: int
    back: dict[int, tuple[int, str, str]]


class Repairer:
    """Frontiers over a graph-structured stack; node 0 is the empty stack."""

    def __init__(self, tables: Tables, insertable: str, costs: Costs = Costs()):
        self.tables, self.insertable, self.costs = tables, insertable, costs
        self.nodes: list[tuple[int, int]] = [(0, -1)]
        self._known: dict[tuple[int, int], int] = {(0, -1): 0}
        self._steps: dict[tuple, Step] = {}
        self._moves: dict[tuple[int, Symbol], list[tuple[int, int, str, str]]] = {}
        self._ahead: dict[tuple[int, str], tuple[int, ...]] = {}

    def _node(self, state: int, below: int) -> int:
        if (state, below) not in self._known:
            if len(self.nodes) >= _MOST_NODES:
                raise ValueError("the grammar nests without a bound")
            self._known[state, below] = len(self.nodes)
            self.nodes.append((state, below))
        return self._known[state, below]

    def _reduced(self, top: int, terminal: str) -> list[int]:
        """The tops that reductions before ``terminal`` lead to, the top itself first."""
        tops = [top]
        for node in tops:
            for head, size in self.tables.reduce.get((self.nodes[node][0], terminal), ()):
                below = node
                for _ in range(size):
                    below = self.nodes[below][1]
                made = self._node(self.tables.goto[self.nodes[below][0], head], below)
                if made not in tops:
                    tops.append(made)
        return tops

    def shift(self, top: int, terminal: str) -> tuple[int, ...]:
        """Stack tops after a terminal."""
        if (top, terminal) not in self._ahead:
            goto = self.tables.goto
            tops = [self._node(to, n) for n in self._reduced(top, terminal) if (to := goto.get((self.nodes[n][0], terminal))) is not None]
            self._ahead[top, terminal] = tuple(tops)
        return self._ahead[top, terminal]

    def accepts(self, top: int) -> bool:
        return any(self.nodes[n][0] in self.tables.accept for n in self._reduced(top, END))

    def tops(self, terminals: str) -> list[int]:
        """Every stack top that a sequence of terminals can lead to."""
        tops = [0]
        for top in tops:
            tops += [t for c in terminals for t in self.shift(top, c) if t not in tops]
        return sorted(set(tops))

    def _inserted(self, top: int) -> dict[int, tuple[int, str, str]]:
        """Tops that inserted terminals lead to: cost, audit, terminals, the cheapest of each."""
        out, ring = {top: (0, "", "")}, [top]
        for node in ring:
            cost, audit, said = out[node]
            for terminal in self.insertable:
                for to in self.shift(node, terminal):
                    if to not in out:  # every insertion costs the same, so the first way is a cheapest
                        out[to] = (cost + self.costs.insert, audit + "I", said + terminal)
                        ring.append(to)
        return out

    def moves(self, top: int, symbol: Symbol) -> list[tuple[int, int, str, str]]:
        """(top, cost, audit, terminals) of all that can be done to a symbol, insertions before it included."""
        if (top, symbol) not in self._moves:
            best: dict[int, tuple[int, str, str]] = {}
            for node, (cost, audit, said) in self._inserted(top).items():
                done = [(node, self.costs.delete, "D", "")]
                if symbol.stays:
                    ways = [(c, self.costs.rewrite, "R") for c in self.insertable if c != symbol.terminal]
                    ways += [(symbol.terminal, self.costs.keep, "K")] if symbol.terminal else []
                    done += [(to, c + symbol.extra, act, t) for t, c, act in ways for to in self.shift(node, t)]
                for to, more, act, terminal in done:
                    new = (cost + more, audit + act, said + terminal)
                    best[to] = min(best.get(to, new), new)
            self._moves[top, symbol] = [(to, *way) for to, way in sorted(best.items())]
        return self._moves[top, symbol]

    @staticmethod
    def begin(top: int = 0) -> tuple[tuple[int, int, int], ...]:
        return ((top, 0, 0),)

    def step(self, frontier: tuple[tuple[int, int, int], ...], symbol: Symbol) -> Step:
        """The frontier after a symbol: of equal tops the least (cost, audit) stays."""
        if (frontier, symbol) not in self._steps:
            best: dict[int, tuple[int, int, str, int, str]] = {}
            for top, cost, rank in frontier:
                for to, more, audit, said in self.moves(top, symbol):
                    new = (cost + more, rank, audit, top, said)
                    best[to] = min(best.get(to, new), new)
            shared = min(way[0] for way in best.values())
            ranks = {audit: i for i, audit in enumerate(sorted({way[1:3] for way in best.values()}))}
            after = tuple((to, way[0] - shared, ranks[way[1:3]]) for to, way in sorted(best.items()))
            if len(self._steps) >= _KEPT_STEPS:
                self._steps.clear()
            self._steps[frontier, symbol] = Step(after, shared, {to: (way[3], way[2], way[4]) for to, way in best.items()})
        return self._steps[frontier, symbol]

    def run(self, symbols: Iterable[Symbol], top: int = 0) -> tuple[dict[int, int], list[Step]]:
        """From one top over all symbols: the cost of every top reached, and the steps."""
        frontier, total, steps = self.begin(top), 0, []
        for symbol in symbols:
            steps.append(self.step(frontier, symbol))
            frontier, total = steps[-1].frontier, total + steps[-1].shared
        return {to: cost + total for to, cost, _ in frontier}, steps

    @staticmethod
    def trace(steps: list[Step], top: int) -> list[tuple[str, str]]:
        """For each symbol the audit and the terminals of the way that ends at a top."""
        out = []
        for step in reversed(steps):
            top, audit, said = step.back[top]
            out.append((audit, said))
        return out[::-1]

    def finish(self, top: int) -> tuple[int, str, str] | None:
        """The cheapest insertions after which the stack is a sentence: cost, audit, terminals."""
        ways = [way for to, way in self._inserted(top).items() if self.accepts(to)]
        return min(ways, default=None)
