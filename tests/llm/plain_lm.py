"""A plain hierarchical Pitman-Yor model of word pairs: one customer at a time, no arrays, no buckets."""

import random
from collections import Counter, defaultdict


class Restaurant:
    def __init__(self, d, strength, above, r):
        self.d, self.strength, self.above, self.r = d, strength, above, r
        self.seats, self.n, self.t = defaultdict(list), 0, 0

    def p(self, dish):
        seats = self.seats.get(dish, ())
        return (sum(seats) - self.d * len(seats) + (self.strength + self.d * self.t) * self.above.p(dish)) / (self.strength + self.n)

    def add(self, dish):
        seats = self.seats[dish]
        weights = [x - self.d for x in seats] + [(self.strength + self.d * self.t) * self.above.p(dish)]
        k = self.r.choices(range(len(weights)), weights)[0]
        self.n += 1
        if k < len(seats):
            seats[k] += 1
        else:
            seats.append(1)
            self.t += 1
            self.above.add(dish)

    def take(self, dish):
        seats = self.seats[dish]
        k = self.r.choices(range(len(seats)), seats)[0]
        seats[k] -= 1
        self.n -= 1
        if not seats[k]:
            seats.pop(k)
            self.t -= 1
            self.above.take(dish)


class Base:
    def __init__(self, known, unknown, types):
        self.known, self.unknown, self.types = known, unknown, types

    def p(self, dish):
        return self.known if dish in self.types else self.unknown

    def add(self, dish):
        pass

    take = add


def averaged(pairs, probes, d1, d0, strength, known, unknown, burn, samples, seed=0):
    """Mean predictive probabilities of the probed (context, word) pairs."""
    r = random.Random(seed)
    root = Restaurant(d0, strength, Base(known, unknown, {w for _, w in pairs}), r)
    leaves = defaultdict(lambda: Restaurant(d1, strength, root, r))
    for u, w in pairs:
        leaves[u].add(w)
    total = Counter()
    for k in range(burn + samples):
        for u, w in pairs:
            leaves[u].take(w)
            leaves[u].add(w)
        for w in list(root.seats):
            for _ in range(sum(root.seats[w])):
                root.take(w)
                root.add(w)
        if k >= burn:
            for u, w in probes:
                total[u, w] += leaves[u].p(w) / samples if u in leaves else root.p(w) / samples
    return dict(total)
