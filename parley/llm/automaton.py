"""Parallel scans of byte strings by a small automaton.

What a stretch of bytes does to an automaton is a function from the state before it to the state after it. The functions of
all stretches form a finite monoid, whose elements are numbered and composed by a table; composition is associative, so a
long string can be cut anywhere, even inside a character, the pieces scanned side by side, and their functions composed.
"""

from __future__ import annotations

import numpy as np

WIDTH = 512


class Automaton:
    """classes: the class of each of the 256 bytes; step[state][class]: the next state; counters[c][state][class]: how much a byte of
    the class adds to counter c in the state."""

    def __init__(self, classes: list[int], step: list[list[int]], counters: list[list[list[int]]]):
        self.classes = np.array(classes, np.uint8)
        self.step = np.array(step, np.uint8)
        self.counters = np.array(counters, np.int64)
        states = len(step)
        found = {tuple(range(states)): 0}
        letters = [found.setdefault(tuple(column), len(found)) for column in self.step.T.tolist()]
        order, i = list(found), 0
        while i < len(order):
            for column in self.step.T.tolist():
                after = tuple(column[s] for s in order[i])
                if after not in found:
                    found[after] = len(order)
                    order.append(after)
            i += 1
        #: act[f][s]: the state after the stretch f from state s. Element 0 changes nothing.
        self.act = np.array(order, np.uint8)
        #: The element that each class is.
        self.letters = np.array(letters, np.uint16)
        size = len(order)
        self.compose = np.array([[found[tuple(self.act[g][list(f)].tolist())] for g in range(size)] for f in order], np.uint16)

    def before(self, elements: np.ndarray) -> tuple[np.ndarray, int]:
        """The composition of all elements before each one, and of all. The string is laid out in rows, which are scanned side by side;
        the rows' own functions are composed in the same way."""
        n, size = len(elements), len(self.compose)
        flat = self.compose.ravel()
        if n <= WIDTH:
            out, now = np.empty(n, np.uint16), 0
            table = self.compose
            for i, e in enumerate(elements.tolist()):
                out[i] = now
                now = int(table[now, e])
            return out, now
        rows = -(-n // WIDTH)
        laid = np.zeros(rows * WIDTH, np.uint16)
        laid[:n] = elements
        laid = np.ascontiguousarray(laid.reshape(rows, WIDTH).T)
        now = np.zeros(rows, np.intp)
        for t in range(WIDTH):
            e = laid[t].copy()
            laid[t] = now
            now = flat[now * size + e].astype(np.intp)
        entries, total = self.before(now.astype(np.uint16))
        return flat[entries.astype(np.intp)[:, None] * size + laid.T].ravel()[:n], total

    def summary(self, data: np.ndarray) -> tuple[list[int], list[list[int]]]:
        """Of a stretch of bytes: the state after it, and what it adds to each counter, for every state before it."""
        kinds = self.classes[data]
        prefix, total = self.before(self.letters[kinds])
        width = len(self.letters)
        met = np.bincount(prefix.astype(np.intp) * width + kinds, minlength=len(self.act) * width).reshape(-1, width)
        return self.act[total].tolist(), [[int((met * counter[self.act[:, s]]).sum()) for s in range(len(self.step))] for counter in self.counters]

    def added(self, data: np.ndarray, state: int = 0) -> np.ndarray:
        """What each byte adds to each counter, from a state."""
        kinds = self.classes[data]
        prefix, _ = self.before(self.letters[kinds])
        return self.counters[:, self.act[prefix, state], kinds]
