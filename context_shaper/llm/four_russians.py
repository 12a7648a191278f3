"""Tables for the cheapest edits that make a sequence of role initials legal.

The legal sequences, ``(s?(ua)+)?``, are those of an automaton with four states: nothing yet, after s,
after u, after a.  A cost vector holds, per state, what the rest of a sequence costs from there.  Less its
least entry, only few different vectors occur, so for every vector and every block of four symbols the
vector before the block is worked out once, and sequences are processed a block per lookup.

Edits are traced from the front.  Inside a block the vectors are worked out backward from the one behind it,
so at every row all edits that keep the least cost are known, and the first in the alphabet is taken.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache
from itertools import product

import numpy as np

BLOCK = 4
NEVER = 1 << 40
START, AFTER_S, AFTER_U, AFTER_A = range(4)
# Symbols of rows: 0 to 3 for initials s, u, a and any other, 4 to 7 for the same truncated.
DELETED, PAD = 8, 9
INITIALS = "sua"
# Rows as letters: clean, truncated, blank or repeated, each with initial s, u, a or another.
ROW_LETTERS = "ABCDEFGHIJKLMNOP"
_SYMBOLS = str.maketrans(ROW_LETTERS, "0123" + "4567" + str(DELETED) * 8)
KEEP = {(START, 0): AFTER_S, (START, 1): AFTER_U, (AFTER_S, 1): AFTER_U, (AFTER_A, 1): AFTER_U, (AFTER_U, 2): AFTER_A}
MAKE = (AFTER_U, AFTER_U, AFTER_A, AFTER_U)  # the state after a row whose role is chosen to fit
TAILS = ("", "II", "I", "")  # what ends a sequence legally
LEGAL = {(0, 1), (1, 2), (2, 1)}

Vector = tuple[int, ...]


@dataclass(frozen=True)
class EditCosts:
    rerole: int = 1
    delete: int = 2
    insert: int = 5
    truncated: int = 5


def _closed(vector: list[int], costs: EditCosts) -> Vector:
    """With rows inserted first where that is cheaper."""
    once = [min(vector[q], costs.insert + vector[MAKE[q]]) for q in range(4)]
    return tuple(min(once[q], costs.insert + once[MAKE[q]]) for q in range(4))


def final_vector(costs: EditCosts) -> Vector:
    return tuple(costs.insert * len(tail) for tail in TAILS)


def _row_edits(symbol: int, state: int, costs: EditCosts) -> list[tuple[str, int, int]]:
    """(letter, cost, next state) of what may be done to a row itself, in the order of the alphabet."""
    edits = [("D", costs.delete, state)]
    if symbol < DELETED:
        extra = costs.truncated if symbol > 3 else 0
        if (state, symbol % 4) in KEEP:
            edits.append(("K", extra, KEEP[state, symbol % 4]))
        edits.append(("R", costs.rerole + extra, MAKE[state]))
    return edits


def vector_before(symbol: int, vector: Vector, costs: EditCosts) -> Vector:
    if symbol == PAD:
        return vector
    return _closed(
        [min(cost + vector[then] for _, cost, then in _row_edits(symbol, q, costs)) for q in range(4)], costs
    )


def _normalised(vector: Vector) -> tuple[Vector, int]:
    least = min(vector)
    return tuple(x - least if x < NEVER else NEVER for x in vector), least


class BlockTables:
    """Transitions of all vectors that can occur over all blocks, and traces of the blocks met."""

    def __init__(self, costs: EditCosts) -> None:
        self.costs = costs
        units = [tuple(0 if q == end else NEVER for q in range(4)) for end in range(4)]
        self.vectors: list[Vector] = []
        self.number: dict[Vector, int] = {}
        steps: list[list[tuple[int, int]]] = []
        for vector in [final_vector(costs), *units]:
            self._add(_normalised(vector)[0])
        while len(steps) < len(self.vectors):
            vector = self.vectors[len(steps)]
            found = [_normalised(vector_before(symbol, vector, costs)) for symbol in range(PAD + 1)]
            steps.append([(self._add(then), least) for then, least in found])
        then, paid = (np.array([[step[i] for step in row] for row in steps], np.int32) for i in range(2))
        blocks = np.array(list(product(range(PAD + 1), repeat=BLOCK)))
        at = np.repeat(np.arange(len(steps))[:, None], len(blocks), axis=1)
        cost = np.zeros(at.shape, np.int32)
        for place in reversed(range(BLOCK)):
            cost += paid[at, blocks[:, place]]
            at = then[at, blocks[:, place]]
        self.then, self.paid = at.tolist(), cost.tolist()
        self._traces: dict[tuple[int, int], list[tuple[str, int]]] = {}

    def _add(self, vector: Vector) -> int:
        if vector not in self.number:
            self.number[vector] = len(self.vectors)
            self.vectors.append(vector)
        return self.number[vector]

    @staticmethod
    def blocks(rows: str) -> list[int]:
        """Numbers of the blocks of a string of row letters, padded behind."""
        symbols = rows.translate(_SYMBOLS)
        symbols += str(PAD) * (-len(symbols) % BLOCK)
        return [int(symbols[at : at + BLOCK]) for at in range(0, len(symbols), BLOCK)]

    def transitions(self, blocks: list[int]) -> list[int]:
        """The least costs from each state before the rows to each state behind them, row by row of 16."""
        columns = []
        for end in range(4):
            at, total = self.number[tuple(0 if q == end else NEVER for q in range(4))], 0
            for block in reversed(blocks):
                total += self.paid[at][block]
                at = self.then[at][block]
            columns.append([total + x if x < NEVER else NEVER for x in self.vectors[at]])
        return [columns[end][q] for q in range(4) for end in range(4)]

    def trace(self, blocks: list[int], behind: Vector) -> list[tuple[str, int]]:
        """(edits, state behind the rows) for each state before them, given the vector behind them."""
        at = self.number[_normalised(behind)[0]]
        ids = []
        for block in reversed(blocks):
            ids.append(at)
            at = self.then[at][block]
        paths = [([], state) for state in range(4)]
        for block, behind_block in zip(blocks, reversed(ids)):
            found = self._traces.get((behind_block, block)) or self._expanded(behind_block, block)
            for number, (edits, state) in enumerate(paths):
                letters, state = found[state]
                edits.append(letters)
                paths[number] = (edits, state)
        return [("".join(edits), state) for edits, state in paths]

    def _expanded(self, behind: int, block: int) -> list[tuple[str, int]]:
        symbols = [int(x) for x in str(block).zfill(BLOCK)]
        vectors = [self.vectors[behind]]
        for symbol in reversed(symbols):
            vectors.insert(0, vector_before(symbol, vectors[0], self.costs))
        found = []
        for state in range(4):
            letters = ""
            for symbol, here, after in zip(symbols, vectors, vectors[1:]):
                if symbol == PAD:
                    continue
                while True:
                    fits = [(x, then) for x, cost, then in _row_edits(symbol, state, self.costs) if cost + after[then] == here[state]]
                    if here[MAKE[state]] + self.costs.insert == here[state]:
                        fits.append(("I", MAKE[state]))
                    letter, state = min(fits)
                    letters += letter
                    if letter != "I":
                        break
            found.append((letters, state))
        self._traces[behind, block] = found
        return found


@lru_cache(maxsize=8)
def block_tables(costs: EditCosts) -> BlockTables:
    return BlockTables(costs)


def through(transitions: list[int], behind: Vector) -> Vector:
    """The vector before rows with these transitions."""
    return tuple(min(transitions[4 * q + end] + behind[end] for end in range(4)) for q in range(4))
