"""Chinese-restaurant seating of a hierarchical Pitman-Yor model, sampled by Gibbs, one customer after the other.

A subtree is the restaurant of one last word and those of the longer contexts that
share it as their parent. Its state is how many tables each dish has in each
restaurant; which customers sit together needn't be known, for given c customers
of a dish at t tables, one of them sits alone with probability
S(c - 1, t - 1) / S(c, t), S being the generalised Stirling numbers of the
discount. A customer leaves; if that empties its table, so does the table's own
customer in the parent, and so up to the root; then it is seated again by the
probabilities of all the others. What its dish's probability is while it is away is
its predictive probability given all other customers. Subtrees are independent given the root, so each
step takes one customer of every subtree at once, by numpy, and of a large one one of each
of several sets of dishes.
"""

from __future__ import annotations

import math
import random
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np


def _rows(d: float, top: int) -> Iterator[np.ndarray]:
    """For c = 1 .. top, logarithms of the generalised Stirling numbers S(c, t) of discount d, t = 0 .. c."""
    row = np.array([-np.inf, 0.0])
    t = np.arange(top + 2, dtype=np.float64)
    for c in range(1, top + 1):
        yield row
        stay = np.append(row[1:] + np.log(c - d * t[1 : c + 1]), -np.inf)  # c customers have no c + 1 tables
        row = np.append(-np.inf, np.logaddexp(row, stay))


def stirling_log(d: float, c: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Logarithms of S(c, t) for each of the pairs, 1 <= t <= c."""
    out, order = np.empty(len(c)), np.argsort(c, kind="stable")
    cut = np.searchsorted(c[order], np.arange(1, int(c.max(initial=0)) + 2))
    for k, row in enumerate(_rows(d, int(c.max(initial=0)))):
        if cut[k] < cut[k + 1]:
            at = order[cut[k] : cut[k + 1]]
            out[at] = row[t[at]]
    return out


def alone(d: float, top: int) -> np.ndarray:
    """[c, t]: the probability that a given one of c customers of a dish at t tables sits alone."""
    out = np.ones((top + 1, top + 1), np.float32)
    out[:, 0] = 0  # they sit at tables that another part of the restaurant has opened
    before = np.array([0.0])
    for c, row in enumerate(_rows(d, top), 1):
        out[c, 1 : c + 1] = np.exp(before - row[1:])
        before = row
    return out


class Hyper(NamedTuple):
    """Discounts and strengths of the root (0), of contexts of one word (1) and of two (2)."""

    d: tuple[float, float, float]
    s: tuple[float, float, float]


class Subtrees:
    """Seatings of many subtrees. Entries are (context of two words, dish).

    n: customers of each entry; leaf: its context; two: its (subtree, dish); dish of
    each ``two``; tree_of_leaf. ``fixed`` is each dish's root probability without this
    partition's customers, ``own`` says that no other partition has any of it;
    ``total`` is the root's number of customers and strength.

    A restaurant is whole, however many customers it has. ``chain`` is only how many
    of one subtree wait for one another: a larger one's dishes are dealt to several
    chains, whose customers move at once and see the restaurant's totals as they were
    before. Entries and ``two`` of more than that, which would make too large a table
    of Stirling numbers, come in parts: ``same`` and ``same2`` name the whole. What the
    other parts have counts in each part's probabilities as of the last sweep's end.

    A customer who is the only one of its entry always takes its table along and always
    opens one, so its context doesn't change; if the dish has no other customer in the
    restaurant of one word either, nothing changes at all, and it is only scored.
    """

    def __init__(self, n: np.ndarray, leaf: np.ndarray, two: np.ndarray, dish: np.ndarray, tree_of_leaf: np.ndarray, same: np.ndarray | None = None, same2: np.ndarray | None = None, chain: int = 512):
        self.tables_of = None
        self.n, self.leaf, self.two, self.dish, self.tree_of_leaf = n.astype(np.int32), leaf, two, dish, tree_of_leaf
        self.same, self.same2 = same, same2
        leaves, trees = len(tree_of_leaf), int(tree_of_leaf.max()) + 1 if len(tree_of_leaf) else 0
        self.C3 = np.bincount(leaf, n, minlength=leaves).astype(np.int32)
        # at first each dish has one table in each restaurant
        self.t3 = np.ones(len(n), np.int32)
        self.T3 = np.bincount(leaf, minlength=leaves).astype(np.int32)
        self.c2 = np.bincount(two, minlength=len(dish)).astype(np.int32)
        self.t2 = np.ones(len(dish), np.int32)
        self.tree2 = np.zeros(len(dish), np.int64)
        self.tree2[two] = tree_of_leaf[leaf]
        self.C2 = np.bincount(self.tree2, self.c2, minlength=trees).astype(np.int32)
        self.T2 = np.bincount(self.tree2, minlength=trees).astype(np.int32)
        self.own2, self.far = self.C2, np.zeros((2, len(dish)))
        self.local = np.bincount(dish).astype(np.int64)  # customers that this partition has at the root
        self.most2 = np.bincount(two, n, minlength=len(dish)).astype(np.int64)  # customers that a dish can have in a restaurant of one word
        self.chain = chain
        self._plan()

    def _plan(self) -> None:
        """Which customers move, and in what order."""
        alone2 = (np.bincount(self.two, minlength=len(self.dish)) == 1) & (self.far[0] == 0)
        if self.same2 is not None:
            alone2 &= np.bincount(self.same2)[self.same2] == 1
        still = (self.n == 1) & alone2[self.two]
        self.still = np.flatnonzero(still)
        self.single, self.several = (self._chains(np.flatnonzero(x), self.chain) for x in ((self.n == 1) & ~still, self.n > 1))

    def _chains(self, e: np.ndarray, chain: int) -> tuple[np.ndarray, np.ndarray]:
        """The entries ``e``, as often as they have customers, step after step; where each step ends. A step has at most one customer of a dish."""
        two = self.two[e]
        many = np.bincount(two, self.n[e], minlength=len(self.dish)).astype(np.int64)
        by = np.argsort(self.tree2, kind="stable")
        before = np.cumsum(many[by]) - many[by]
        first = np.flatnonzero(np.append(True, np.diff(self.tree2[by]) != 0)) if len(by) else by
        before -= np.repeat(before[first], np.diff(np.append(first, len(by))))
        of = np.empty(len(by), np.int64)
        of[by] = self.tree2[by] << 24 | before // chain
        order = np.argsort(of[two], kind="stable")
        seq = np.repeat(e[order], self.n[e[order]])
        name = of[self.two[seq]]
        first = np.flatnonzero(np.append(True, name[1:] != name[:-1])) if len(name) else np.zeros(0, np.int64)
        step = np.arange(len(seq)) - np.repeat(first, np.diff(np.append(first, len(seq))))
        return seq[np.argsort(step, kind="stable")].astype(np.int32), np.cumsum(np.bincount(step)) if len(step) else np.zeros(0, np.int64)

    def root(self, fixed: np.ndarray, own: np.ndarray, total: float, d0: float) -> None:
        self.fixed, self.less, self.total = fixed.astype(np.float64), d0 * own, total

    def join(self, trees: np.ndarray, totals: np.ndarray, twos: np.ndarray, far: np.ndarray) -> None:
        """Before the first sweep: what other partitions have in the restaurants of ``trees``. totals: their customers and tables; far: those of each of ``twos``, and whether a table of its own stands at first."""
        self.own2 = self.C2.copy()
        self.far[:, twos] = far[:2]
        gone = twos[far[2] == 0]
        self.t2[gone] = 0
        np.add.at(self.T2, self.tree2[gone], -1)
        np.add.at(self.local, self.dish[gone], -1)
        self.C2[trees] += totals[0].astype(np.int32)
        self.T2[trees] += totals[1].astype(np.int32)
        self._plan()

    def _elsewhere(self, h: Hyper) -> tuple[np.ndarray, np.ndarray]:
        """Of each entry and of each ``two``: what its other parts, here and in other partitions, have beyond the shares of parents."""
        out = []
        for c, t, d, same in ((self.n, self.t3, h.d[2], self.same), (self.c2, self.t2, h.d[1], self.same2)):
            if same is None:
                out.append(np.zeros(len(c)))
            else:
                c, t = (np.bincount(same, x)[same] - x for x in (c, t))  # whole numbers, so that what has no other part has exactly 0
                out.append(c - d * t)
        return out[0], out[1] + self.far[0] - h.d[1] * self.far[1]

    def sweep(self, h: Hyper, rng: np.random.Generator, score: bool = True) -> np.ndarray:
        """Every customer leaves once and is seated again. Of each entry, the mean probability of its dish while one of its customers was away, if ``score``."""
        d2, d3, s2, s3 = h.d[1], h.d[2], h.s[1], h.s[2]
        if self.tables_of != (d2, d3):  # the same for all sweeps of one draw
            self.tables_of, self.alone = (d2, d3), (alone(d3, int(self.n.max(initial=1))), alone(d2, int(self.most2.max(initial=1))))
        q3, q2 = (x.ravel() for x in self.alone)
        w3, w2 = (len(x) for x in self.alone)
        C3, t3, T3, c2, t2, C2, T2, local = self.C3, self.t3, self.T3, self.c2, self.t2, self.C2, self.T2, self.local
        seen = np.zeros(len(self.n) if score else 0)
        other3, other2 = self._elsewhere(h)

        def laid(seq: np.ndarray) -> tuple[np.ndarray, ...]:
            m, r = self.two[seq], self.leaf[seq]
            w = self.dish[m]
            return seq, m, r, w, self.tree_of_leaf[r], self.fixed[w], self.less[w], other2[m]

        seq, ends = self.single
        all_of, i = laid(seq), 0
        for k in ends.tolist():
            e, m, r, w, j, fixed, less, more = (x[i:k] for x in all_of)
            u = rng.random((2, k - i), np.float32)
            i = k
            cm, tm = c2[m], t2[m]
            up = u[0] < q2[cm * w2 + tm]
            tm -= up
            tj = T2[j] - up
            stay = cm - 1 - d2 * tm + more
            both = stay + (s2 + d2 * tj) * (fixed + np.maximum(local[w] - up - less, 0) / self.total)
            if score:
                seen[e] = both * (s3 + d3 * (T3[r] - 1)) / ((s2 + C2[j] - 1) * (s3 + C3[r] - 1))
            rises = u[1] * both >= stay
            t2[m] = tm + rises
            at = np.flatnonzero(up != rises)
            if len(at):
                by = np.where(rises[at], 1, -1)
                np.add.at(T2, j[at], by)
                np.add.at(local, w[at], by)
        seq, ends = self.several
        all_of, i = (*laid(seq), self.n[seq], C3[self.leaf[seq]], other3[seq]), 0
        for k in ends.tolist():
            e, m, r, w, j, fixed, less, more, c, cr, more3 = (x[i:k] for x in all_of)
            u = rng.random((4, k - i), np.float32)
            i = k
            t, cm, tm = t3[e], c2[m], t2[m]
            gone = u[0] < q3[c * w3 + t]
            up = gone & (u[1] < q2[cm * w2 + tm])
            stay2 = cm - gone - d2 * (tm - up) + more
            both2 = stay2 + (s2 + d2 * (T2[j] - up)) * (fixed + np.maximum(local[w] - up - less, 0) / self.total)
            stay3 = c - 1 - d3 * (t - gone) + more3
            both3 = stay3 + (s3 + d3 * (T3[r] - gone)) * both2 / (s2 + C2[j] - gone)
            if score:
                np.add.at(seen, e, both3 / (s3 + cr - 1))
            opens = u[2] * both3 >= stay3
            at = np.flatnonzero(opens != gone)
            if len(at):
                by = np.where(opens[at], 1, -1).astype(np.int32)
                t3[e[at]] += by
                c2[m[at]] += by
                np.add.at(T3, r[at], by)
                np.add.at(C2, j[at], by)
            rises = opens & (u[3] * both2 >= stay2)
            at = np.flatnonzero(up != rises)
            if len(at):
                by = np.where(rises[at], 1, -1)
                t2[m[at]] += by.astype(np.int32)
                np.add.at(T2, j[at], by)
                np.add.at(local, w[at], by)
        if score:
            e = self.still
            r, w = self.leaf[e], self.dish[self.two[e]]
            j = self.tree_of_leaf[r]
            p = self.fixed[w] + np.maximum(local[w] - 1 - self.less[w], 0) / self.total
            seen[e] = p * (s2 + d2 * (T2[j] - 1)) * (s3 + d3 * (T3[r] - 1)) / ((s2 + C2[j] - 1) * (s3 + C3[r] - 1))
            seen /= self.n
        return seen

    def predict(self, h: Hyper) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """By entry its probability; by entry and by context what it has beyond its parent's share, and that share; by ``two`` and by subtree the same.

        What the parts of an entry or of a ``two`` have adds up; the probability is that of all parts.
        """
        d2, d3, s2, s3 = h.d[1], h.d[2], h.s[1], h.s[2]
        other3, other2 = self._elsewhere(h)
        root = self.fixed[self.dish] + np.maximum(self.local - self.less, 0)[self.dish] / self.total
        share2 = (s2 + d2 * self.T2) / (s2 + self.C2)
        more2 = (self.c2 - d2 * self.t2) / (s2 + self.C2)[self.tree2]
        p2 = more2 + other2 / (s2 + self.C2)[self.tree2] + share2[self.tree2] * root
        share3 = (s3 + d3 * self.T3) / (s3 + self.C3)
        more3 = (self.n - d3 * self.t3) / (s3 + self.C3)[self.leaf]
        return more3 + other3 / (s3 + self.C3)[self.leaf] + share3[self.leaf] * p2[self.two], more3, share3, more2, share2

    def counts(self) -> list[np.ndarray]:
        """For contexts of one and of two words: how often each (customers, tables) of a dish occurs; and each number of customers, and of tables, of a restaurant, beside 0; rows (customers, tables, times)."""
        out = []
        for c, t in ((self.c2, self.t2), (self.C2, self.T2), (self.n, self.t3), (self.C3, self.T3)):
            if c is self.c2 or c is self.n:
                key, times = np.unique((c.astype(np.int64) << 32 | t)[t > 0], return_counts=True)  # parts whose customers all sit at another part's tables have no number of seatings
            else:  # see restaurants_log: a sum over the ones and one over the others
                parts = [np.unique(c.astype(np.int64) << 32, return_counts=True), np.unique(t.astype(np.int64), return_counts=True)]
                key, times = (np.concatenate(x) for x in zip(*parts, strict=True))
            out.append(np.stack([key >> 32, key & 0xFFFFFFFF, times], 1))
        return out


def add_counts(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    both = np.concatenate([a, b])
    key, at = np.unique(both[:, 0] << 32 | both[:, 1], return_inverse=True)
    return np.stack([key >> 32, key & 0xFFFFFFFF, np.bincount(at, both[:, 2], minlength=len(key)).astype(np.int64)], 1)


DISCOUNTS = tuple(np.round(np.arange(0.04, 0.99, 0.04), 2).tolist())
STRENGTHS = tuple(np.round(np.geomspace(0.05, 200, 25), 4).tolist())


def _lgamma(x: np.ndarray) -> np.ndarray:
    return np.array([math.lgamma(y) for y in x.tolist()])


def restaurants_log(rows: np.ndarray, d: float, s: float) -> float:
    """Log probability of the numbers of tables of restaurants (customers, tables, times), without the Stirling numbers."""
    c, c_at = np.unique(rows[:, 0], return_inverse=True)
    t, t_at = np.unique(rows[:, 1], return_inverse=True)
    rise = gamma_log(s / d + t) - gamma_log(np.array([s / d])) + t * np.log(d)
    fall = gamma_log(s + c) - gamma_log(np.array([s]))
    return float(((rise[t_at.ravel()] - fall[c_at.ravel()]) * rows[:, 2]).sum())


def _drawn(logs: list[float], rng: np.random.Generator) -> int:
    w = np.exp(np.array(logs) - max(logs))
    return int(rng.choice(len(w), p=w / w.sum()))


def draw_hyper(dishes: np.ndarray, restaurants: np.ndarray, s: float, rng: np.random.Generator) -> tuple[float, float]:
    """A discount and a strength drawn from their conditionals given all seatings, on a grid with equal prior weights."""
    if not len(dishes):
        return 0.5, 1.0
    c, t, times = dishes.T
    d = DISCOUNTS[_drawn([restaurants_log(restaurants, d, s) + float((stirling_log(d, c, t) * times).sum()) for d in DISCOUNTS], rng)]
    return d, STRENGTHS[_drawn([restaurants_log(restaurants, d, x) for x in STRENGTHS], rng)]


_BERNOULLI = (1 / 12, -1 / 360, 1 / 1260, -1 / 1680)


def gamma_log(x: np.ndarray) -> np.ndarray:
    """Logarithms of the gamma function for x > 0, by Stirling's series from 10 on, to some 1e-13 of their size."""
    x = np.asarray(x, np.float64)
    low = np.zeros_like(x)
    y = x.copy()
    for _ in range(10):
        small = y < 10
        low = np.where(small, low + np.log(np.where(small, y, 1.0)), low)
        y = np.where(small, y + 1, y)
    z = 1 / (y * y)
    tail = sum(b * z**k for k, b in enumerate(_BERNOULLI)) / y
    return (y - 0.5) * np.log(y) - y + 0.9189385332046727 + tail - low


def seat(c: np.ndarray, p: np.ndarray, others: np.ndarray, d: float, s: float, rng: np.random.Generator) -> np.ndarray:
    """Tables of each dish after its c customers are seated in turn. p: the parent's probability; others: tables of other dishes there.

    At t tables customer n + 1 opens one with probability r(n) = a / (n - dt + a), a
    being the weight of a new table. As r falls, the next candidate is a geometric
    time away and is accepted with r there over r here: drawn exactly, and a step
    costs as much as the tables it opens, not the customers.
    """
    c = c.astype(np.float64)
    t, n = np.minimum(c, 1.0), np.minimum(c, 1.0)
    live = np.flatnonzero(c > 1)
    while len(live) > 8:
        a = (s + d * (others[live] + t[live])) * p[live]
        x = n[live] - d * t[live]
        r = a / (x + a)
        with np.errstate(divide="ignore"):
            gap = np.floor(np.minimum(np.log(rng.random(len(live))) / np.log1p(-np.minimum(r, 1 - 1e-12)), 1e15))
        opens = (rng.random(len(live)) * r < a / (x + gap + a)) & (n[live] + gap < c[live])
        n[live] += gap + 1
        t[live] += opens
        live = live[n[live] < c[live]]
    plain = random.Random(int(rng.integers(1 << 60)))
    for i in live.tolist():  # the last ones open thousands: one by one without arrays
        ci, pi, oi, ni, ti = float(c[i]), float(p[i]), s + d * float(others[i]), float(n[i]), float(t[i])
        while ni < ci:
            a, x = (oi + d * ti) * pi, ni - d * ti
            r = a / (x + a)
            gap = math.floor(min(math.log(1 - plain.random()) / math.log1p(-min(r, 1 - 1e-12)), 1e15))
            ti += plain.random() * r < a / (x + gap + a) and ni + gap < ci
            ni += gap + 1
        t[i] = ti
    return t
