"""Seating in Pitman-Yor restaurants: how many tables serve each dish, sampled given the tables of the other dishes.

A dish with c customers and base probability p, in a restaurant with `other` tables of other dishes, is seated customer
by customer: with n seated at t tables, the next one opens a table with weight (strength + discount (other + t)) p, or
joins one with weight n - discount t. Such a seating is the proposal of a Metropolis-Hastings step: its target, the
product of these weights, differs from its probability by the product of their sums over the steps, so a seating is
taken with the ratio of its product to that of the present one. The conditional distribution of the seating is kept
exactly. A dish of two or three customers has two or four seatings, and one of them is drawn by its weight, which is that
conditional itself. Waits for the next new table are drawn in one go: they are geometric with a beta-distributed chance,
so a step costs as much as there are tables, not customers.
"""

from __future__ import annotations

import numpy as np

STRENGTH, DISCOUNT = 1.0, 0.5
#: So many dishes or fewer are seated one by one.
FEW = 8


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Logarithm of the gamma function for x > 0, by Stirling's series seven places on."""
    product = x.copy()
    for k in range(1, 7):
        product *= x + k
    z = x + 7
    return (z - 0.5) * np.log(z) - z + 0.9189385332046727 + 1 / (12 * z) - 1 / (360 * z**3) + 1 / (1260 * z**5) - 1 / (1680 * z**7) - np.log(product)


class Restaurants:
    """Pairs of a restaurant (`house`) and a dish with c customers; `held` overrides the customers of each house, where it has more elsewhere.

    scale and outside say how many tables a house has in all: scale x those here, and `outside` more.
    """

    def __init__(self, house: np.ndarray, c: np.ndarray, held: np.ndarray | None = None, discount: float = DISCOUNT, strength: float = STRENGTH):
        self.house, self.discount, self.strength = house, discount, strength
        self.houses = int(house.max()) + 1 if len(house) else 0
        self.scale, self.outside = np.ones(self.houses), np.zeros(self.houses)
        self.owner, self.after = np.zeros(0, np.int64), np.zeros(0, np.int64)  # tables but the first: whose, and after how many customers
        self.c, self.new = np.zeros(len(house), np.int64), np.ones(len(house), bool)
        self.customers(c)
        if held is not None:
            self.held = held

    def customers(self, c: np.ndarray) -> None:
        """New numbers of customers; tables that none of them would open are gone."""
        stay = self.after < c[self.owner]
        self.owner, self.after, self.c = self.owner[stay], self.after[stay], c
        self.t = np.minimum(c, 1) + np.bincount(self.owner, minlength=len(c))
        self.held = np.bincount(self.house, weights=c, minlength=self.houses)

    def own_tables(self) -> np.ndarray:
        return np.bincount(self.house, weights=self.t, minlength=self.houses)

    def tables(self) -> np.ndarray:
        """Tables of each house in all."""
        return self.own_tables() * self.scale + self.outside

    def predictive(self, base: np.ndarray) -> np.ndarray:
        """The probability of each dish in its house."""
        fresh = (self.strength + self.discount * self.tables()) / (self.strength + self.held)
        return (self.c - self.discount * self.t) / (self.strength + self.held[self.house]) + fresh[self.house] * base

    def sweep(self, base: np.ndarray, rng: np.random.Generator) -> None:
        """One step for the dishes of two or more customers; with one customer there is one table. A dish's first step takes its seating as it is drawn."""
        tables = self.tables()
        owners, times = [], []
        few = np.flatnonzero((self.c == 2) | (self.c == 3))
        if len(few):
            room = self.strength + self.discount * (tables[self.house[few]] - self.t[few])
            second, third = self.exact(self.c[few], room, base[few], rng)
            owners += [few[second], few[third]]
            times += [np.ones(int(second.sum()), np.int64), np.full(int(third.sum()), 2)]
        some = np.flatnonzero(self.c > 3)
        if len(some):
            room = self.strength + self.discount * (tables[self.house[some]] - self.t[some])
            c, p = self.c[some], base[some]
            place = np.full(len(self.c), -1, np.int32)
            place[some] = np.arange(len(some))
            old = place[self.owner]
            old, before = old[old >= 0], self.after[old >= 0]
            owner, after = self.propose(c, room, p, rng)
            gain = self.weight(c, room, p, owner, after) - self.weight(c, room, p, old, before)
            take = (np.log(rng.random(len(some))) < gain) | self.new[some]
            self.new[some] = False
            owners += [some[old[~take[old]]], some[owner[take[owner]]]]
            times += [before[~take[old]], after[take[owner]]]
        if not owners:
            return
        own, when = np.concatenate(owners), np.concatenate(times)
        # each dish's tables stand in order of time already
        order = np.argsort(own, kind="stable")
        self.owner, self.after = own[order], when[order]
        self.t = np.minimum(self.c, 1) + np.bincount(self.owner, minlength=len(self.c))

    def exact(self, c: np.ndarray, room: np.ndarray, p: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
        """For dishes of two or three customers, whether the second and the third open a table: of the two or four seatings one is drawn by its weight."""
        d = self.discount
        opens, again, three = (room + d) * p, (room + 2 * d) * p, c == 3
        alone = (1 - d) * np.where(three, 2 - d + opens, 1.0)
        apart = opens * np.where(three, 2 - 2 * d + again, 1.0)
        second = rng.random(len(c)) * (alone + apart) < apart
        new, old = np.where(second, again, opens), np.where(second, 2 - 2 * d, 2 - d)
        return second, three & (rng.random(len(c)) * (new + old) < new)

    def propose(self, c: np.ndarray, room: np.ndarray, p: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
        """Tables but the first: the dish of each, and after how many customers it opens; by dish and time."""
        active, seated, t = np.arange(len(c)), np.ones(len(c), np.int64), 1
        owners, times = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        while len(active) > FEW:
            chance = rng.beta((room[active] + self.discount * t) * p[active], seated - self.discount * t)
            wait = rng.geometric(np.maximum(chance, 1e-15))
            open_ = seated + wait <= c[active]
            active, seated, t = active[open_], seated[open_] + wait[open_], t + 1
            owners.append(active)
            times.append(seated - 1)
        # the few dishes of the most tables, each by itself: an array of a few costs more than they do
        for i, n in zip(active.tolist(), seated.tolist()):
            own, most, opened, when = float(room[i]), int(c[i]), t, []
            share = float(p[i])
            while (n := n + int(rng.geometric(max(rng.beta((own + self.discount * opened) * share, n - self.discount * opened), 1e-15)))) <= most:
                when.append(n - 1)
                opened += 1
            owners.append(np.full(len(when), i))
            times.append(np.array(when, np.int64))
        owner, after = np.concatenate(owners), np.concatenate(times)
        order = np.argsort(owner, kind="stable")
        return owner[order], after[order]

    def weight(self, c: np.ndarray, room: np.ndarray, p: np.ndarray, owner: np.ndarray, after: np.ndarray) -> np.ndarray:
        """Logarithm of the product, over all steps of each dish's seating, of the sum of the weights."""
        # a stretch with t tables goes from the opening of the last of them to the next one's
        many = np.bincount(owner, minlength=len(c)) + 1
        dish = np.repeat(np.arange(len(c)), many)
        first = np.cumsum(many) - many
        t = np.arange(len(dish)) - first[dish] + 1
        lo, hi = np.zeros(len(dish)), np.empty(len(dish))
        later = np.ones(len(dish), bool)
        later[first] = False
        lo[later] = after
        hi[:-1] = lo[1:]
        hi[first + many - 1] = c - 1
        shift = (room[dish] + self.discount * t) * p[dish] - self.discount * t + 1
        return np.bincount(dish, weights=log_gamma(hi + shift) - log_gamma(lo + shift), minlength=len(c))
