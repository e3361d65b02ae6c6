"""Seating of Pitman-Yor restaurants by Metropolis-within-Gibbs, for arrays of dishes at once.

A dish's seating is the list of those of its customers (1st, 2nd, ...) that opened a table; the sizes of its tables are
summed out. With i customers at t tables, the next opens one with odds a : i - discount * t, where a = (strength + discount *
tables of the restaurant) * the parent's probability of the dish. Until the next table opens this is a Polya urn, so the
waiting time is geometric with a beta-distributed chance: one draw a table, not a customer, and exact at any size.

A move takes the customers after a random one away and seats them anew by these odds, given the tables of all other dishes.
Seating in order is not the posterior, as the odds' normalisers depend on the path, so the move is accepted by their ratio.
Dishes of a restaurant move together, given each other's tables before the move.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Values of the griddy Gibbs steps for the two parameters of a level.
DISCOUNTS = np.array([0.02, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 0.95])
STRENGTHS = np.array([0.02, 0.1, 0.5, 2.0, 8.0, 32.0, 128.0, 512.0, 2048.0, 8192.0, 32768.0])


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Stirling's series above 8, and the recurrence below: x (x + 1) ... (x + 7) as y (y + 6) (y + 10) (y + 12) of y = x (x + 7)."""
    y, low = x, np.flatnonzero(x < 8)
    if len(low):
        small = x[low]
        y = x.copy()
        y[low] = small + 8
    z = 1 / (y * y)
    out = (y - 0.5) * np.log(y) - y + (0.5 * np.log(2 * np.pi) + (1 / 12 - z * (1 / 360 - z * (1 / 1260 - z / 1680))) / y)
    if len(low):
        shift = small * (small + 7)
        out[low] -= np.log(shift * (shift + 6) * (shift + 10) * (shift + 12))
    return out


@dataclass
class Seating:
    """Customers and tables of each dish; openers: the customers that opened its second and later tables, dish after dish."""

    customers: np.ndarray
    tables: np.ndarray
    openers: np.ndarray

    def owners(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.tables)), np.maximum(self.tables - 1, 0))


def at_one_table(customers: np.ndarray) -> Seating:
    return Seating(customers.astype(np.int64), np.minimum(customers, 1).astype(np.int64), np.zeros(0, np.int64))


def openings(rng, dish: np.ndarray, seated: np.ndarray, tables: np.ndarray, customers: np.ndarray, others: np.ndarray, parent: np.ndarray, strength: float, discount: float) -> tuple[np.ndarray, np.ndarray]:
    """(dish, customer) of each table that opens while the dishes' customers after the seated ones sit down in order."""
    found, when = [], []
    at, t, end, rest, p = seated.astype(np.float64), tables.astype(np.float64), customers, others, parent
    while len(dish):
        chance = rng.beta(np.maximum((strength + discount * (rest + t)) * p, 1e-300), at - discount * t)
        with np.errstate(divide="ignore", over="ignore"):
            at = at + np.ceil(np.log(1 - rng.random(len(dish))) / np.log1p(-np.minimum(chance, 1 - 1e-16))).clip(1)
        on = at <= end
        dish, at, t, end, rest, p = dish[on], at[on], t[on] + 1, end[on], rest[on], p[on]
        found.append(dish)
        when.append(at.astype(np.int64))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(found), np.concatenate(when)


def normalisers(n: int, owner: np.ndarray, opener: np.ndarray, seated: np.ndarray, tables: np.ndarray, customers: np.ndarray, others: np.ndarray, parent: np.ndarray, strength: float, discount: float) -> np.ndarray:
    """For each of n dishes, the log of the product of the odds' sums over the customers after the seated ones.

    opener: sorted by owner and customer; owner: which dish's.
    """
    count = np.bincount(owner, minlength=n)
    first = np.cumsum(count + 1) - count - 1
    start = np.empty(len(owner) + n)
    start[first] = seated
    place = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    start[np.repeat(first, count) + 1 + place] = opener
    stop = np.append(start[1:], 0.0)
    stop[first + count] = customers
    dish = np.repeat(np.arange(n), count + 1)
    t = tables[dish] + np.arange(len(start)) - first[dish]
    odds = (strength + discount * (others[dish] + t)) * parent[dish] - discount * t
    return np.add.reduceat(log_gamma(odds + stop) - log_gamma(odds + start), first) if n else np.zeros(0)


def move(rng, s: Seating, held: np.ndarray, parent: np.ndarray, strength: float, discount: float) -> Seating:
    """One move of every dish with two or more customers. held: all tables of the dish's restaurant."""
    live = np.flatnonzero(s.customers > 1)
    n = len(live)
    if not n:
        return s
    c, p, others = s.customers[live], parent[live], (held - s.tables)[live].astype(np.float64)
    cut = np.maximum(1, (c ** rng.random(n)).astype(np.int64))  # none of the first is taken away
    owner = s.owners()  # only live dishes have second tables
    back = np.full(len(s.tables), -1)
    back[live] = np.arange(n)
    owner = back[owner]
    early = s.openers <= cut[owner]
    before = 1 + np.bincount(owner[early], minlength=n)
    new_owner, new = openings(rng, np.arange(n), cut, before, c, others, p, strength, discount)
    order = np.lexsort((new, new_owner))
    new_owner, new = new_owner[order], new[order]
    rest = (cut, before, c, others, p, strength, discount)
    gain = normalisers(n, new_owner, new, *rest) - normalisers(n, owner[~early], s.openers[~early], *rest)
    taken = np.log(1 - rng.random(n)) < gain
    keep, add = early | ~taken[owner], taken[new_owner]
    all_owner, every = np.concatenate([owner[keep], new_owner[add]]), np.concatenate([s.openers[keep], new[add]])
    tables = s.tables.copy()
    tables[live] = 1 + np.bincount(all_owner, minlength=n)
    return Seating(s.customers, tables, every[np.lexsort((every, all_owner))])


def with_customers(rng, s: Seating, customers: np.ndarray, held: np.ndarray, parent: np.ndarray, strength: float, discount: float) -> Seating:
    """The seating after the last customers of some dishes have left, or new ones have sat down."""
    owner = s.owners()
    stays = s.openers <= customers[owner]
    owner, openers = owner[stays], s.openers[stays]
    tables = np.minimum(customers, 1) + np.bincount(owner, minlength=len(customers))
    more = np.flatnonzero(customers > np.maximum(s.customers, 1))
    others = (held - s.tables)[more].astype(np.float64)
    new_owner, new = openings(rng, more, np.maximum(s.customers, 1)[more], tables[more], customers[more], others, parent[more], strength, discount)
    owner, openers = np.concatenate([owner, new_owner]), np.concatenate([openers, new])
    order = np.lexsort((openers, owner))
    return Seating(customers, np.minimum(customers, 1) + np.bincount(owner, minlength=len(customers)), openers[order])


def dish_evidence(s: Seating) -> np.ndarray:
    """For each of DISCOUNTS, the log of the chances of all customers that joined a table of their dish."""
    alone = (s.customers > 1) & (s.tables == 1)
    size, times = np.unique(s.customers[alone], return_counts=True)
    live = s.tables > 1
    c, t = s.customers[live].astype(np.float64), s.tables[live]
    first = np.cumsum(t) - t
    start = np.ones(int(t.sum()))
    hole = np.ones(len(start), bool)
    hole[first] = False
    start[hole] = s.openers
    stop = np.append(start[1:], 1.0)[: len(start)] - 1
    stop[first + t - 1] = c
    number = np.arange(len(start)) - np.repeat(first, t) + 1
    joined = lambda a, b, k, d: log_gamma(b - d * k) - log_gamma(a - d * k)
    return np.array([(joined(start, stop, number, d)).sum() + (times * joined(np.ones(len(size)), size.astype(np.float64), 1, d)).sum() for d in DISCOUNTS])


def restaurant_evidence(customers: np.ndarray, tables: np.ndarray) -> np.ndarray:
    """For each of DISCOUNTS and STRENGTHS (flattened), the log of the chances of all tables opened and of all sums of odds."""
    some = customers > 1
    key, times = np.unique((customers[some].astype(np.int64) << 32) | tables[some].astype(np.int64), return_counts=True)
    c, t = (key >> 32).astype(np.float64), (key & 0xFFFFFFFF).astype(np.float64)
    out = np.zeros((len(DISCOUNTS), len(STRENGTHS)))
    for j, strength in enumerate(STRENGTHS):
        every = log_gamma(strength + c) - log_gamma(np.array([strength + 1.0]))
        for i, d in enumerate(DISCOUNTS):
            opened = log_gamma(strength / d + t) - log_gamma(np.array([strength / d + 1])) + (t - 1) * np.log(d)
            out[i, j] = (times * (opened - every)).sum()
    return out.ravel()


def draw_parameters(rng, dishes: np.ndarray, restaurants: np.ndarray) -> tuple[float, float]:
    """(strength, discount), drawn from their posterior over the grid given the seating; all values are equally likely before."""
    log_p = restaurants.reshape(len(DISCOUNTS), len(STRENGTHS)) + dishes[:, None]
    p = np.exp(log_p - log_p.max()).ravel()
    k = int(np.searchsorted(np.cumsum(p) / p.sum(), rng.random(), "right"))
    i, j = divmod(min(k, p.size - 1), len(STRENGTHS))
    return float(STRENGTHS[j]), float(DISCOUNTS[i])
