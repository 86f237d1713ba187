"""The cheapest repair of a conversation's roles: an input acceptor, an edit transducer and a grammar acceptor, composed lazily.

A row of the conversation is a symbol: the first letter of its role, and what is wrong with it. A state of the composition
is a place between rows with a state of the grammar; arcs are made when a symbol first meets a grammar state. Weights are
(cost, labels), compared in this order. Costs are found from the last place to the first, as each place comes before the
next. Labels are then read from the first place on: from a state each label leads to one state only, so the least label
among the arcs that keep the cost begins the least string of labels.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

#: States: nothing yet, after system, after user, after assistant. What each first letter leads to.
GRAMMAR = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
FINAL = (0, 3)
START = 0
#: Roles that edits write, by the grammar's state behind them.
WRITTEN = {2: "user", 3: "assistant"}
KEEP, REROLE, DELETE, INSERT, TRUNCATION = 0, 2, 3, 2, 1
FINE, BLANK, DUPLICATE, TRUNCATED = range(4)
INITIALS = ("s", "u", "a")
NEVER = 1 << 50


def symbol(role: str, fault: int) -> int:
    """Of 16. Any other first letter, or none, is the fourth."""
    first = role[:1]
    return 4 * (INITIALS.index(first) if first in INITIALS else 3) + fault


def edits(code: int) -> Iterator[tuple[str, str | None, int]]:
    """(label, first letter that it writes, cost) of what may be done to a symbol."""
    initial, fault = divmod(code, 4)
    yield "D", None, DELETE
    if fault in (BLANK, DUPLICATE):
        return
    more = TRUNCATION if fault == TRUNCATED else 0
    if initial < 3:
        yield "K", INITIALS[initial], KEEP + more
    for letter in "ua":
        yield "R", letter, REROLE + more


class Step(NamedTuple):
    """What a symbol makes of the costs behind it: the costs before it, less their least, which is shift; and the choice of each state."""

    shift: int
    vector: tuple[int, ...]
    choice: tuple[tuple[str, int], ...]


@lru_cache(maxsize=1 << 16)
def step(code: int, behind: tuple[int, ...]) -> Step:
    arcs = [[(label, cost, state if letter is None else GRAMMAR[state][letter]) for label, letter, cost in edits(code) if letter is None or letter in GRAMMAR[state]] for state in range(4)]
    inserts = [[to for letter, to in GRAMMAR[state].items() if letter in "ua"] for state in range(4)]
    best = [min(cost + behind[to] for _, cost, to in arcs[state]) for state in range(4)]
    # what is inserted never leads to a state a second time, as that costs more
    for _ in range(3):
        best = [min([best[state], *(INSERT + best[to] for to in inserts[state])]) for state in range(4)]
    choice = tuple(min([(label, to) for label, cost, to in arcs[state] if cost + behind[to] == best[state]] + [("I", to) for to in inserts[state] if INSERT + best[to] == best[state]]) for state in range(4))
    low = min(best)
    return Step(low, tuple(min(x - low, NEVER) for x in best), choice)


#: What is missing at the end, by state.
END = (0, 2 * INSERT, INSERT, 0)


def backward(codes: bytes, behind: list[int] | tuple[int, ...]) -> tuple[list[int], list[Step]]:
    """The costs before these symbols, by state, and each symbol's step."""
    low = min(behind)
    vector = tuple(min(x - low, NEVER) for x in behind)
    steps = []
    for c in reversed(codes):
        s = step(c, vector)
        low, vector = low + s.shift, s.vector
        steps.append(s)
    return [low + x for x in vector], steps[::-1]


def transfer(codes: bytes) -> list[int]:
    """Cost from each state before these symbols to each state behind them, what is inserted behind them left out: 16 numbers."""
    columns = [backward(codes, [0 if i == to else NEVER for i in range(4)])[0] for to in range(4)]
    return [min(columns[to][state], NEVER) for state in range(4) for to in range(4)]


def before(matrix: list[int], behind: list[int] | tuple[int, ...]) -> list[int]:
    """The costs before a block, by its transfer and the costs behind it."""
    return [min(matrix[4 * state + to] + behind[to] for to in range(4)) for state in range(4)]


def walk(steps: list[Step], state: int) -> Iterator[tuple[str, int, int]]:
    """(label, number of the symbol that it stands at, state behind it)."""
    for i, s in enumerate(steps):
        label = "I"
        while label == "I":
            label, state = s.choice[state]
            yield label, i, state


def closing(state: int) -> list[int]:
    """The states that inserted rows lead to at the end."""
    out = []
    while state not in FINAL:
        state = GRAMMAR[state]["a" if state == 2 else "u"]
        out.append(state)
    return out
