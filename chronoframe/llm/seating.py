"""Chinese-restaurant seating of the customers of many cells, by Gibbs steps.

A cell holds the customers of one dish in one restaurant.  They are alike, so a cell is an array of table labels.
A step takes one customer out of the present seating and seats it again: at a table of n others with weight
n - discount, at a new one with weight (strength + discount * the restaurant's tables) * the parent's probability
of the dish.  Steps go over all cells at once, a customer of each; the last cells, of the most customers, are gone
through one by one.  Every customer of every cell is reseated once in a sweep.
"""

from __future__ import annotations

import random
from collections.abc import Callable

import numpy as np

from chronoframe.llm.kernel import ragged

#: With fewer cells left than this, a step over all of them takes longer than a loop.
MANY = 60
#: Times that a seat is drawn by a customer already there; who is refused then is seated by the weights of all tables.
DRAWS = 3


class Seats:
    """``c`` customers by cell; the first ``have`` of each sit at the tables that ``z`` (flat, by cell) names.

    ``row`` is each cell's restaurant and ``tables`` the tables of each restaurant, ``col`` is its place in the
    parent and ``above`` the customers there: both are kept current.  ``parent(col, above)`` gives the parent's
    probabilities; what else it depends on stays as it is during a sweep.
    """

    def __init__(self, c: np.ndarray, have: np.ndarray, z: np.ndarray, discount: float, strength: float, row: np.ndarray, tables: np.ndarray, col: np.ndarray, above: np.ndarray, parent: Callable, seed: list[int]):
        self.c, self.discount, self.strength = c.astype(np.int64), discount, strength
        self.tables, self.above, self.parent = tables.astype(np.float64, copy=False), above.astype(np.float64, copy=False), parent
        self.r, self.one = np.random.default_rng(seed), random.Random(repr(seed))
        self.off = np.cumsum(self.c) - self.c
        self.z = np.zeros(int(self.c.sum()), np.int32)
        self.z[slice(None) if len(z) == len(self.z) else ragged(self.off, have)] = z
        self.have = have.astype(np.int64)
        self.row, self.col = row.astype(np.int64), col.astype(np.int64)
        some = np.flatnonzero(self.have)
        bound = np.zeros(len(self.c), np.int64)
        if len(some):
            bound[some] = np.maximum.reduceat(z, (np.cumsum(self.have) - self.have)[some]) + 1
        self._relabel(bound)

    def _relabel(self, bound: np.ndarray) -> None:
        """Labels, which are under ``bound``, get no gaps."""
        kind = np.int32 if bound.sum() + len(self.z) < 1 << 31 else np.int64
        at = slice(None) if (self.have == self.c).all() else ragged(self.off, self.have)
        first = np.cumsum(bound) - bound
        key = np.repeat(first.astype(kind), self.have)
        key += self.z[at]
        #: Customers of the tables, and tables of each cell.
        self.sizes, self.used = np.bincount(key, minlength=int(bound.sum())).astype(np.int32), bound
        alive = self.sizes > 0
        if not alive.all():
            rank = np.concatenate([np.zeros(1, kind), np.cumsum(alive, dtype=kind)])
            base = rank[first]
            self.z[at] = rank[key] - np.repeat(base, self.have)
            self.sizes, self.used = self.sizes[alive], (rank[first + bound] - base).astype(np.int64)

    def _room(self) -> None:
        """Room for a new table for each customer."""
        room = self.used + self.c
        self.slot = np.cumsum(room) - room
        self.n = np.zeros(int(room.sum()), np.int32)
        self.n[ragged(self.slot, self.used)] = self.sizes
        self.narrow = np.int32 if len(self.n) < 1 << 31 else np.int64

    def _changed(self, row: np.ndarray, col: np.ndarray, by: float) -> None:
        np.add.at(self.tables, row, by)
        np.add.at(self.above, col, by)

    def _step(self, off: np.ndarray, slot: np.ndarray, row: np.ndarray, col: np.ndarray, used: np.ndarray, alive: np.ndarray, j: np.ndarray | int, others: np.ndarray, move: bool) -> None:
        """Customer j of each cell; all arrays are by cell, the labels ``used`` and the tables ``alive`` are changed in place."""
        at = off + j
        tables, above = self.tables[row], self.above[col]
        if move:
            k = slot + self.z[at]
            n = self.n[k] - 1
            self.n[k] = n
            shut = np.flatnonzero(n == 0)
            # each cell sees its own customer gone and those of the others, which move at the same time, seated
            tables[shut] -= 1
            above[shut] -= 1
            if len(shut):
                alive[shut] -= 1
                self._changed(row[shut], col[shut], -1.0)
        tables *= self.discount
        tables += self.strength
        tables *= self.parent(col, above)
        own = others - self.discount * alive
        x = self.r.random(len(off))
        x *= own + tables
        opened = x >= own
        label = np.empty(len(off), np.int32)
        live = np.flatnonzero(~opened)
        for _ in range(DRAWS):
            if not len(live):
                break
            x = self.r.random(len(live))
            x *= others[live]
            q = x.astype(off.dtype)
            x -= q
            if move:
                q += q >= (j if isinstance(j, int) else j[live])
            q += off[live]
            z = self.z[q]
            # a uniform customer's table, taken with probability (n - discount) / n
            ok = ((1 - x) * self.n[slot[live] + z] > self.discount) | (others[live] == 1)
            label[live[ok]] = z[ok]
            live = live[~ok]
        if len(live):  # by the weights of all tables
            sizes = used[live].astype(np.int64)
            weight = np.maximum(self.n[ragged(slot[live], sizes)] - self.discount, 0)
            total = np.concatenate([[0], np.cumsum(weight)])
            end = np.cumsum(sizes)
            low, high = total[end - sizes], total[end]
            at_table = np.searchsorted(total, low + self.r.random(len(live)) * (high - low), side="right") - 1
            label[live] = np.minimum(at_table, end - 1) - (end - sizes)
        new = np.flatnonzero(opened)
        label[new] = used[new]
        self.z[at] = label
        self.n[slot + label] += 1
        if len(new):
            used[new] += 1
            alive[new] += 1
            self._changed(row[new], col[new], 1.0)

    def _loop(self, cell: int, j: int, alive: int, move: bool) -> None:
        """As ``_step``, for the customers j, j + 1, ... of one cell."""
        off, c, slot, row, col, used, draw, d = int(self.off[cell]), int(self.c[cell]), int(self.slot[cell]), self.row[cell], self.col[cell], int(self.used[cell]), self.one.random, self.discount
        z, n = self.z[off : off + c].tolist(), self.n[slot : slot + used + c].tolist()
        one = np.array([col])

        def weight() -> float:
            return float((self.strength + d * self.tables[row]) * self.parent(one, self.above[one])[0])

        a = weight()
        s, own = c - 1, c - 1 - d * alive
        for j in range(j, c):
            if move:
                k = z[j]
                n[k] -= 1
                if not n[k]:
                    self.tables[row] -= 1
                    self.above[col] -= 1
                    alive -= 1
                    a, own = weight(), s - d * alive
            else:
                s, own = j, j - d * alive
            if draw() * (own + a) >= own:
                z[j], n[used] = used, 1
                used += 1
                self.tables[row] += 1
                self.above[col] += 1
                alive += 1
                a, own = weight(), s - d * alive
                continue
            while True:
                x = draw() * s
                q = int(x)
                k = z[q + 1 if move and q >= j else q]
                if (1 - x + q) * n[k] > d:
                    z[j] = k
                    n[k] += 1
                    break
        self.z[off : off + c] = z
        self.n[slot : slot + len(n)] = n
        self.used[cell] = used

    def _over(self, cells: np.ndarray, first: np.ndarray, move: bool) -> None:
        """Customers ``first`` .. c of each cell, a customer of every cell in each step."""
        left = self.c[cells] - first
        most = int(left.max(initial=0))
        order = np.argsort((most - left).astype(np.uint16) if most < 1 << 16 else -left, kind="stable")  # short numbers are sorted by radix
        cells, first, left = cells[order], first[order], -left[order]
        self._room()
        off, slot, used, others = (x[cells].astype(self.narrow) for x in (self.off, self.slot, self.used, self.c - 1))
        row, col = self.row[cells], self.col[cells]
        alive = used.copy()  # labels have no gaps yet
        low = int(first[0]) if len(first) and (first == first[0]).all() else None
        for k in range(most):
            m = int(np.searchsorted(left, -k, side="left"))
            if m < MANY:
                self.used[cells] = used
                for i in range(m):
                    self._loop(int(cells[i]), int(first[i]) + k, int(alive[i]), move)
                return
            j = first[:m] + k if low is None else low + k
            seated = others[:m] if move else np.broadcast_to(j, m)
            self._step(off[:m], slot[:m], row[:m], col[:m], used[:m], alive[:m], j, seated, move)
        self.used[cells] = used

    def come(self) -> None:
        """The customers without a seat come in."""
        self._over(np.arange(len(self.c)), self.have, False)
        self.have = self.c
        self._relabel(self.used)

    def sweep(self) -> None:
        """Every customer is taken out and seated again; a cell's only customer always has the one table."""
        cells = np.flatnonzero(self.c > 1)
        self._over(cells, np.zeros(len(cells), np.int64), True)
        self._relabel(self.used)
