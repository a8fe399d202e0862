"""Seating of Chinese restaurants with discounts, for many dishes at once.

The customers of a dish sit at tables that serve it.  A dish is opened at a new
table with weight ``weight * (strength + discount * tables)``, where ``weight``
is the parent's probability of the dish and ``tables`` those of the whole
restaurant; a table of ``s`` customers draws another one with weight
``s - discount``.  ``tables`` is taken as of the last state for what other
dishes did since, and exactly for a dish's own tables, so that all dishes can
be worked on side by side.

All steps are exact, whatever the number of customers, and cost steps in the
number of tables only:

* ``arrive`` seats customers one after another.  The customers between two new
  tables are not walked through: the chance that the next m all join is the
  m-th moment of a beta variable, so their number is geometric given a draw of
  that variable, and how they divide among the tables is beta-binomial.
* ``leave`` takes out customers chosen at random.
* ``reseat`` is the whole sweep: all customers of every dish get up, and sit
  down one after another.  Seats taken one after another divide each weight by
  the sum of all at that moment, which the seating's distribution does not.  So
  new tables are opened with their weight times ``_lean``, about what a table
  more does to the later sums, and the dish takes its new seating with chance
  ``min(1, new / old)``, both being what a seating's weight is divided by in
  coming about this way (Metropolis and Hastings).  What becomes of the old one
  is counted over an order of arrival chosen at random.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Beyond this numpy has no hypergeometric draws; the binomial's error is below one in a million there.
HYPERGEOMETRIC = 900_000_000
#: Keeps divisions finite.
TINY = 1e-300
#: First steps towards the saddle point.
LEAN_STEPS = 3
#: By steps, dishes that open a table, and the table's place in their order of arrival, from 1.
Events = list[tuple[np.ndarray, np.ndarray]]


@dataclass
class Seats:
    """Tables, ordered by dish (from 0 to ``dishes`` - 1), and their customers."""

    dishes: int
    dish: np.ndarray
    size: np.ndarray

    @classmethod
    def empty(cls, dishes: int) -> Seats:
        return cls(dishes, np.empty(0, np.int64), np.empty(0, np.int64))

    def tables(self) -> np.ndarray:
        return np.bincount(self.dish, minlength=self.dishes)

    def customers(self) -> np.ndarray:
        ends = np.searchsorted(self.dish, np.arange(self.dishes + 1))
        return np.diff(np.concatenate([[0], np.cumsum(self.size)])[ends])

    def of(self, chosen: np.ndarray) -> Seats:
        """Those of the dishes that a mask chooses, numbered anew."""
        here = chosen[self.dish]
        return Seats(int(chosen.sum()), (np.cumsum(chosen) - 1)[self.dish[here]], self.size[here])


@dataclass
class House:
    """What the dishes of a state meet: see above.  ``weight`` and ``tables`` per dish; ``tables`` without the dish's own."""

    weight: np.ndarray
    tables: np.ndarray
    strength: float
    discount: float

    def of(self, chosen: np.ndarray) -> House:
        return House(self.weight[chosen], self.tables[chosen], self.strength, self.discount)

    def new(self, own: np.ndarray) -> np.ndarray:
        """Weight of a new table for each dish that has ``own`` tables."""
        return self.weight * (self.strength + self.discount * (self.tables + own))


def _share(rng: np.random.Generator, many: np.ndarray, here: np.ndarray, there: np.ndarray) -> np.ndarray:
    """How many of ``many`` arrivals go here, by weights that grow by one with each arrival."""
    return rng.binomial(many, rng.beta(here, there))


def _joined(t: np.ndarray, left: np.ndarray, events: Events, d: float, rng: np.random.Generator) -> tuple[list, list]:
    """Dishes and sizes of the tables opened, by steps, as ``left`` customers sit at ``t`` tables; both go down by these."""
    dish, size = [], []
    for who, at in reversed(events):  # of those after a new table, some joined it and the rest are others'
        t[who] -= 1
        joined = np.where(t[who] > 0, 0, left[who] - at)
        some = np.flatnonzero((t[who] > 0) & (left[who] > at))
        if len(some):
            w = who[some]
            joined[some] = _share(rng, left[w] - at[some], np.full(len(w), 1 - d), at[some] - 1 - d * t[w])
        size.append(1 + joined)
        left[who] -= 1 + joined
        dish.append(who)
    return dish, size


def arrive(seats: Seats, more: np.ndarray, house: House, rng: np.random.Generator) -> Seats:
    """``more`` customers of each dish sit down."""
    d = house.discount
    before, end = seats.customers(), seats.customers() + more
    t = seats.tables()
    old = t.copy()
    i = before.copy()
    active = np.flatnonzero(more > 0)
    events: Events = []
    first = active[before[active] == 0]
    if len(first):  # the first customer opens a table
        i[first], t[first] = 1, 1
        events.append((first, np.ones(len(first), np.int64)))
    active = active[end[active] > i[active]]
    while len(active):
        x = rng.beta(house.of(active).new(t[active]), i[active] - d * t[active])
        with np.errstate(divide="ignore", over="ignore"):
            gap = np.floor(np.log(1 - rng.random(len(active))) / np.log1p(-x))
        opens = gap < end[active] - i[active]
        active, gap = active[opens], gap[opens].astype(np.int64)
        i[active] += gap + 1
        t[active] += 1
        events.append((active, i[active]))
        active = active[end[active] > i[active]]
    left = end.copy()
    dish, size = _joined(t, left, events, d, rng)
    grown = seats.size.copy()
    waiting = np.where(old > 0, left - before, 0)
    rest = before - d * old
    for at, of in _ranks(seats):
        of_open = waiting[of] > 0
        at, of = at[of_open], of[of_open]
        if not len(at):
            continue
        here = seats.size[at] - d
        rest[of] -= here
        last = rest[of] < 1e-9 * here  # no table after this one
        taken = waiting[of].copy()
        some = np.flatnonzero(~last)
        if len(some):
            taken[some] = _share(rng, waiting[of[some]], here[some], rest[of[some]])
        grown[at] += taken
        waiting[of] -= taken
    return _ordered(seats.dishes, np.concatenate([seats.dish, *dish]), np.concatenate([grown, *size]))


def leave(seats: Seats, fewer: np.ndarray, rng: np.random.Generator) -> Seats:
    """``fewer`` customers of each dish, chosen at random, go."""
    size, going, here = seats.size.copy(), fewer.copy(), seats.customers()
    for at, of in _ranks(seats):
        some = going[of] > 0
        at, of = at[some], of[some]
        if not len(at):
            continue
        good, bad = size[at], here[of] - size[at]
        small = here[of] <= HYPERGEOMETRIC
        taken = np.empty(len(at), np.int64)
        taken[small] = rng.hypergeometric(good[small], bad[small], going[of][small])
        g, b, m = good[~small], bad[~small], going[of][~small]
        taken[~small] = np.clip(rng.binomial(m, g / np.maximum(g + b, 1)), np.maximum(0, m - b), np.minimum(g, m))
        here[of] -= size[at]
        size[at] -= taken
        going[of] -= taken
    stays = size > 0
    return Seats(seats.dishes, seats.dish[stays], size[stays])


def _places(seats: Seats, rng: np.random.Generator) -> np.ndarray:
    """When each dish's tables are opened, in order, if its customers come to their seats in random order.

    They come at uniform times.  Of each table, the share of time left when its first customer comes is drawn, and
    between two of these how many others come.
    """
    rest = (1 - rng.random(len(seats.size))) ** (1 / seats.size)
    order = np.lexsort((-rest, seats.dish))
    rest, size = rest[order], seats.size[order]
    out = np.empty(len(size), np.int64)
    others, last, place = np.zeros(seats.dishes, np.int64), np.ones(seats.dishes), np.zeros(seats.dishes, np.int64)
    for at, of in _ranks(seats):
        between = rng.binomial(others[of], np.clip(1 - rest[at] / last[of], 0, 1))
        others[of] += size[at] - 1 - between
        last[of] = rest[at]
        place[of] += 1 + between
        out[at] = place[of]
    return out


def _lean(at: np.ndarray, t: np.ndarray, n: np.ndarray, new: np.ndarray, weight: np.ndarray, d: float, lean: np.ndarray) -> np.ndarray:
    """About how many times more weight the seatings of ``n`` customers have with one more than ``t`` tables now.

    ``at`` customers are seated.  The weight of all that may follow is the coefficient of ``x**(n - at)`` in
    ``y**-(at - d*t) * (1 - weight * (1 - y**d))**-(new / (d * weight))``, ``y`` being ``1 - x``; one more table
    multiplies the function by what is returned, taken a step closer to the saddle point than ``lean`` was.
    """
    z = at - d * t + new * lean
    power = (z / (n - at + z)) ** d
    return power / (1 - weight + weight * power)


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """But for a constant."""
    steps = x.copy()
    for k in range(1, 8):
        steps *= x + k
    x = x + 8
    y = 1 / (x * x)
    return (x - 0.5) * np.log(x) - x + (1 / 12 - y * (1 / 360 - y * (1 / 1260 - y / 1680))) / x - np.log(steps)


def _log_sums(low: np.ndarray, high: np.ndarray, more: np.ndarray) -> np.ndarray:
    """Logarithms of the products of ``i + more``, for ``i`` from ``low`` to ``high`` - 1."""
    out = np.log(low + more)
    some = np.flatnonzero(high - low > 1)
    out[some] = _log_gamma(high[some] + more[some]) - _log_gamma(low[some] + more[some])
    return out


def _walk(n: np.ndarray, house: House, rng: np.random.Generator, places: np.ndarray | None = None, first: np.ndarray | None = None):
    """``n`` customers of each dish arrive; the tables opened, and the logarithm of what the seating's weight is divided by.

    With ``places``, those of each dish beginning at ``first``, tables are opened there, else as drawn.
    """
    d, who = house.discount, np.arange(len(n))
    events: Events = [(who, np.ones(len(n), np.int64))]
    divided, lean, started = np.zeros(len(n)), np.ones(len(n)), False
    i, t = np.ones(len(n), np.int64), np.ones(len(n), np.int64)
    if places is not None:
        places = np.append(places, 0)
        last = np.append(first[1:], len(places) - 1) - first  # tables of each dish
    while True:
        going = i < n
        if not going.all():
            who, i, t, n, lean, house = who[going], i[going], t[going], n[going], lean[going], house.of(going)
        if not len(who):
            return events, divided
        new = house.new(t)
        ahead = np.flatnonzero(n > i + 1)  # for the last customer it is one
        now = lean[ahead]
        for _ in range(1 if started else LEAN_STEPS):
            now = _lean(i[ahead] + 1, t[ahead], n[ahead], new[ahead], house.weight[ahead], d, now)
        lean, started = np.ones(len(who)), True
        lean[ahead] = now
        step = np.minimum(i // 2, (i - d * t) / (new * lean + TINY)).astype(np.int64)  # to the next table, on average
        stage = np.minimum(n, i + np.maximum(1, step))  # the lean holds until there or to the next table
        far = np.flatnonzero(stage - i > 1)
        lean[far] = _lean((i[far] + stage[far] + 1) / 2, t[far], n[far], new[far], house.weight[far], d, lean[far])
        new *= lean
        if places is None:
            x = rng.beta(new, i - d * t)
            with np.errstate(divide="ignore", over="ignore", invalid="ignore"):
                gap = np.floor(np.log(1 - rng.random(len(who))) / np.log1p(-x))
            opens = gap < stage - i
            high = stage.copy()
            high[opens] = i[opens] + gap[opens].astype(np.int64) + 1
        else:
            due = np.where(t < last[who], places[np.minimum(first[who] + t, len(places) - 1)], n + 1)
            opens = due <= stage
            high = np.minimum(stage, due)
        divided[who] += _log_sums(i, high, new - d * t) - np.where(opens, np.log(lean), 0.0)
        i, t = high, t + opens
        if opens.any():
            events.append((who[opens], high[opens]))


def _anew(seats: Seats, house: House, rng: np.random.Generator) -> tuple[Seats, np.ndarray]:
    """Dishes with all their customers, two or more, seated anew; and which of them took their new seats."""
    n, t = seats.customers(), seats.tables()
    events, gain = _walk(n, house, rng)
    more = n > 2  # all seatings of two are divided by the same
    if more.any():
        _, old = _walk(n[more], house.of(more), rng, _places(seats.of(more), rng), (np.cumsum(t[more]) - t[more]))
        gain[more] -= old
    takes = ~more | (np.log(1 - rng.random(len(n))) <= gain)
    events = [(who[takes[who]], at[takes[who]]) for who, at in events]
    opened = np.bincount(np.concatenate([who for who, _ in events]), minlength=len(n))
    dish, size = _joined(opened, n.copy(), events, house.discount, rng)
    kept = ~takes[seats.dish]
    return _ordered(len(n), np.concatenate([seats.dish[kept], *dish]), np.concatenate([seats.size[kept], *size])), takes


def reseat(seats: Seats, house: House, rng: np.random.Generator) -> Seats:
    """One sweep: all customers of each dish get up and sit down again."""
    many = seats.customers() > 1  # a single customer always has one table
    if not many.any():
        return seats
    moved, _ = _anew(seats.of(many), house.of(many), rng)
    kept = ~many[seats.dish]
    dish = np.concatenate([seats.dish[kept], np.flatnonzero(many)[moved.dish]])
    return _ordered(seats.dishes, dish, np.concatenate([seats.size[kept], moved.size]))


def _ranks(seats: Seats):
    """For k = 0, 1, ...: places of each dish's table number k, and those dishes."""
    first = np.searchsorted(seats.dish, np.arange(seats.dishes))
    t = seats.tables()
    live = np.flatnonzero(t > 0)
    k = 0
    while len(live):
        yield first[live] + k, live
        k += 1
        live = live[t[live] > k]


def _ordered(dishes: int, dish: np.ndarray, size: np.ndarray) -> Seats:
    order = np.argsort(dish, kind="stable")
    return Seats(dishes, dish[order], size[order])
