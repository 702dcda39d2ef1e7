"""Cheapest repairs of a run of turns as shortest paths, found by auction.

The lattice has a node per turn of the run and state of the grammar
``(s?(ua)+)?`` over the initials of the roles. Arcs are edits with whole-number
costs: keeping, re-roling or deleting a turn leads to the next turn, inserting
one stays before the same turn. A path from the first turn to beyond the last
one is a repair.

The auction keeps a price per node, never above what any arc out of it costs
including the price at its end, and a path from the origin whose arcs are all
tight, that is, cost just the difference of the prices. At the path's last
node either the price rises to that of its best arc and the path contracts, or
the best arc is tight and the path extends along it, until it ends at the
destination. Prices only rise, so further origins start from those of the
first. All shortest paths consist of tight arcs; tight arcs that lead to the
destination are followed by the least letter, which gives the least string.

What every repair pays at a turn is taken out of the arcs before: prices then
have less far to rise. Turns that must be deleted leave the state alone and
count as one step however many there are in a row.
"""

from __future__ import annotations

import functools

# Fixed values ---------------------------------------------------------------
RE_ROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: States: nothing yet, after the system turn, after a user's, after an assistant's.
START, SYSTEM, USER, ASSISTANT = range(4)
#: The state that a turn of this initial leads to.
KEEPS = {
    (START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (ASSISTANT, "u"): USER, (USER, "a"): ASSISTANT,
}
#: The state that the next turn of the pattern leads to, whose role an edit gives.
NEXT = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
#: Where a conversation may end.
ENDS = (0, None, None, 0)
ROLES = {USER: "user", ASSISTANT: "assistant"}
# ----------------------------------------------------------------------------

INF = float("inf")
#: Runs whose repairs a worker keeps; most short conversations are alike.
KEPT = 1 << 14


def parse(run: str) -> list[tuple[str, str, int]]:
    """``initial, status, count`` of every kind of turn in a run.

    The run is text: an initial (``s``, ``u``, ``a`` or ``x``), a status (``o``
    as it should be, ``t`` truncated, ``f`` to be deleted) and how many equal
    turns stand there; all but the first of them must be deleted.
    """
    return [(x[0], x[1], int(x[2:])) for x in run.split()]


class Lattice:
    """Steps of a run, their arcs, and prices of its nodes."""

    def __init__(self, run: str, exits: tuple, last: bool):
        self.base = 0  # what every path pays
        self.steps: list[tuple[str, bool, int]] = []  # initial and truncation of a turn, or a number of deletions
        for initial, status, count in parse(run):
            if status != "f":
                self.steps.append((initial, status == "t", 0))
                count -= 1
            if count:
                self.base += DELETE * count
                if self.steps and self.steps[-1][2]:
                    self.steps[-1] = ("", False, self.steps[-1][2] + count)
                else:
                    self.steps.append(("", False, count))
        self.exits = exits
        # a state from which no exit can be reached is never entered
        open_exits = {s for s, e in enumerate(exits) if e is not None}
        alive = [any(e == s or e >= USER or s == START for e in open_exits) for s in range(4)]
        self.goal = 4 * (len(self.steps) + 1)
        self.arcs: list[list[tuple[int, int, str]]] = []
        for k, (initial, cut, deletions) in enumerate(self.steps):
            if deletions:
                here = [[("D" * deletions, 0, s)] for s in range(4)]
            else:
                extra = TRUNCATED if cut else 0
                here = []
                for s in range(4):
                    found = [("D", DELETE, s), ("R", RE_ROLE + extra, NEXT[s])]
                    if (s, initial) in KEEPS:
                        found.append(("K", extra, KEEPS[s, initial]))
                    here.append(found)
                least = min(cost for found in here for _, cost, _ in found)
                self.base += least
                here = [[(letters, cost - least, s) for letters, cost, s in found] for found in here]
            for s in range(4):
                arcs = [(cost, 4 * (k + 1) + to, letters) for letters, cost, to in here[s] if alive[to]]
                if alive[NEXT[s]]:
                    arcs.append((INSERT, 4 * k + NEXT[s], "I"))
                self.arcs.append(arcs)
        for s in range(4):
            arcs = [] if exits[s] is None else [(exits[s], self.goal, "")]
            # a turn inserted between two runs belongs to the second
            if last and alive[NEXT[s]]:
                arcs.append((INSERT, 4 * len(self.steps) + NEXT[s], "I"))
            self.arcs.append(arcs)
        self.price = [0] * (self.goal + 1)

    def auction(self, origin: int) -> float:
        """Extend and contract a path from the origin until it ends at the goal; its length, or infinity."""
        price, arcs, goal, path = self.price, self.arcs, self.goal, [origin]
        while True:
            node = path[-1]
            best, to = INF, -1
            for cost, end, _ in arcs[node]:
                if cost + price[end] < best:
                    best, to = cost + price[end], end
            if price[node] < best:
                price[node] = best
                if len(path) > 1:
                    path.pop()
                elif best == INF:
                    return INF
            elif to < 0:
                if len(path) == 1:
                    return INF
                path.pop()
            elif to == goal:
                return price[origin]
            else:
                path.append(to)

    def trace(self, origin: int) -> tuple[str, int]:
        """The least letters along tight arcs that lead to the goal, and the state at the end."""
        price, arcs, goal = self.price, self.arcs, self.goal
        leads: dict[int, list] = {goal: []}
        stack = [origin]
        while stack:  # which nodes lead to the goal, ends first
            node = stack[-1]
            if node in leads:
                stack.pop()
                continue
            tight = [a for a in arcs[node] if a[0] + price[a[1]] == price[node] != INF]
            missing = [end for _, end, _ in tight if end not in leads]
            if missing:
                stack += missing
            else:
                leads[node] = sorted((letters, end) for _, end, letters in tight if end == goal or leads[end])
                stack.pop()
        letters, node = [], origin
        while True:
            text, end = leads[node][0]
            if end == goal:
                return "".join(letters), node % 4
            letters.append(text)
            node = end


@functools.lru_cache(maxsize=KEPT)
def repairs(run: str, exits: tuple = ENDS, last: bool = True, entries: tuple = (START,)) -> tuple:
    """Per entry state: cost, letters and end state of the best repair, or None.

    ``exits`` has what a repair that ends in a state still has to pay after
    this run, None where it may not end; the cost returned leaves that out.
    """
    lattice = Lattice(run, exits, last)
    found = []
    for entry in entries:
        length = lattice.auction(entry)
        if length == INF:
            found.append(None)
        else:
            letters, end = lattice.trace(entry)
            found.append((lattice.base + length - exits[end], letters, end))
    return tuple(found)


@functools.lru_cache(maxsize=KEPT)
def costs(run: str, last: bool) -> tuple:
    """Cost of the best repair from every entry state to every end state, row by row; None where there is none."""
    columns = []
    for end in range(4):
        lattice = Lattice(run, tuple(0 if s == end else None for s in range(4)), last)
        lengths = [lattice.auction(entry) for entry in range(4)]
        columns.append([None if x == INF else lattice.base + x for x in lengths])
    return tuple(columns[end][entry] for entry in range(4) for end in range(4))


def illegal(run: str, before: str = "") -> int:
    """Neighbours in a run, and between it and the initial before it, that the pattern has not."""
    count = 0
    for initial, _, copies in parse(run):
        count += copies - 1 + (before != "" and before + initial not in ("su", "ua", "au"))
        before = initial
    return count
