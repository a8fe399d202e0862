"""The hierarchical Pitman-Yor model: seating by exact distributions, probabilities and scores by plain samplers."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from gatewise.llm import common, language_model, posts
from gatewise.llm.seating import House, Seats, _anew, arrive, leave, reseat

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu".split()
SCHEMA = "doc_id long, text string, id string, ids long, kind string, body string, a int"
def learn():
    return common.fold_number(F.col("doc_id")) != language_model.HELD_OUT


def rows():
    rng = random.Random(4)
    texts = [" ".join(rng.choices(WORDS, [1 / (k + 1) for k in range(len(WORDS))], k=rng.randrange(1, 40))) for _ in range(40)]
    texts += [texts[0]] * 3 + ["", None, " \n\t ", "Alpha BETA É\x85é x", "once only", " ".join(f"w{k % 1900}" for k in range(3000))]
    return [*enumerate(texts), (None, "alpha beta"), (None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "x", 1, "k", "b", 2) for i, t in rows()], SCHEMA).repartition(3)


def learned(i):
    return zlib.crc32(("" if i is None else str(i)).encode()) % 5 != 1


def bigrams(text):
    words = language_model.tokens((text or "").encode())
    return list(zip([language_model.EDGE, *words], words))


def hashed(word):
    return xxhash.xxh64_intdigest(word, 42)


def bodies(frame):
    return [posts.unpack(bytes(r["body"])) for r in frame.orderBy("to").collect()]


def opened(model):
    """count by word, back and p by state and word, own by pair that occurs more than once"""
    count, back, p, own = {}, defaultdict(dict), defaultdict(dict), {}
    totals = model.totals
    for (w, c), (_, _, *kept) in zip(bodies(model.asked["vocabulary"]), bodies(model.words["root"])):
        count.update(zip(w.tolist(), c.tolist()))
        for k, root in enumerate(totals.roots):
            left, chance = totals.state(root, c, *kept[3 * k : 3 * k + 3])
            back[k].update(zip(w.tolist(), left.tolist()))
            p[k].update(zip(w.tolist(), chance.tolist()))
    for (u, h, n), state in zip(bodies(model.asked["many"]), bodies(model.pairs["state"])):
        seats = Seats(len(n), state[3], state[4])
        assert (seats.customers() == n).all() and (n > 1).all()
        mean = n - totals.discount * state[5] / len(totals.roots)
        own.update(zip(zip(u.tolist(), h.tolist()), mean.tolist()))
    return count, back, p, own


def test_counts_probabilities_and_scores(docs):
    model = language_model.fit(docs, learn())
    got = defaultdict(list)
    for r in language_model.score(model).collect():
        got[r["doc_id"]].append(r)
    train, pairs = Counter(), Counter()
    for i, t in rows():
        if learned(i):
            pairs.update((hashed(u), hashed(h)) for u, h in bigrams(t))
            train.update(h for _, h in bigrams(t))
    n, v = sum(train.values()), len(train)
    assert (model.totals.n, model.totals.v) == (n, v) and len(model.totals.roots) == language_model.SWEEPS - language_model.BURN_IN
    count, back, p, own = opened(model)
    assert {w: c for w, c in count.items() if c} == {hashed(w): c for w, c in train.items()}
    assert set(own) == {k for k, c in pairs.items() if c > 1}
    known = [w for w, c in count.items() if c]
    for k, root in enumerate(model.totals.roots):
        assert sum(p[k][w] for w in known) + root.probability(0.0) == pytest.approx(1)
    held = defaultdict(float)
    for (u, h), c in pairs.items():
        held[u] += own[u, h] if c > 1 else 1 - model.totals.discount
    for u in known:  # every restaurant: its own share and what it leaves to the root
        left = np.mean([back[k][u] for k in range(len(model.totals.roots))])
        assert held[u] / (language_model.CHILD_STRENGTH + count[u]) + left == pytest.approx(1)

    def chance(u, h):
        mine = own[u, h] if pairs[u, h] > 1 else (1 - model.totals.discount) * pairs[u, h]
        shared = np.mean([back[k][u] * p[k][h] for k in range(len(model.totals.roots))])
        return mine / (language_model.CHILD_STRENGTH + count[u]) + shared

    assert sorted(map(repr, got)) == sorted({repr(i) for i, _ in rows()}) and sum(map(len, got.values())) == len(rows())
    for i, t in rows():
        if i is None:
            continue
        (r,) = got[i]
        words = language_model.tokens((t or "").encode())
        assert r["n_tokens"] == len(words) and r["n_known"] == sum(train[w] > 0 for w in words)
        assert r["base_score"] == pytest.approx(sum(math.log10((train[w] + 0.5) / (n + 0.5 * (v + 1))) for w in words))
        assert r["score"] == pytest.approx(sum(math.log10(chance(hashed(u), hashed(h))) for u, h in bigrams(t)), rel=1e-9)


class Plain:
    """The same model, sampled customer by customer with every table written out."""

    def __init__(self, pairs, discount, root_discount, v, seed):
        self.rng, self.d, self.e, self.v = random.Random(seed), discount, root_discount, v
        self.at, self.root, self.size, self.open = defaultdict(list), defaultdict(list), Counter(), Counter()
        self.customers, self.tables = 0, 0
        self.all = [k for k, c in pairs.items() for _ in range(c)]
        for k in self.all:
            self.sit(k)

    def base(self, h):
        share = (language_model.ROOT_STRENGTH + self.e * self.tables) / (self.v + 1)
        return (sum(self.root[h]) - self.e * len(self.root[h]) + share) / (language_model.ROOT_STRENGTH + self.customers)

    def choose(self, tables, discount, new):
        weights = [s - discount for s in tables] + [new]
        k = self.rng.choices(range(len(weights)), weights)[0]
        if k == len(tables):
            tables.append(0)
        tables[k] += 1
        return tables[k] == 1

    def sit(self, k):
        u, h = k
        if self.choose(self.at[k], self.d, (language_model.CHILD_STRENGTH + self.d * self.open[u]) * self.base(h)):
            self.open[u] += 1
            new = (language_model.ROOT_STRENGTH + self.e * self.tables) / (self.v + 1)
            self.tables += self.choose(self.root[h], self.e, new)
            self.customers += 1

    def rise(self, k):
        u, h = k
        if self.leave(self.at[k]):
            self.open[u] -= 1
            self.customers -= 1
            self.tables -= self.leave(self.root[h])

    def leave(self, tables):
        k = self.rng.choices(range(len(tables)), tables)[0]
        tables[k] -= 1
        if tables[k]:
            return False
        tables.pop(k)
        return True

    def sweep(self):
        for k in self.all:
            self.rise(k)
            self.sit(k)

    def chance(self, u, h, count):
        tables = self.at.get((u, h), [])
        mine = sum(tables) - self.d * len(tables)
        return (mine + (language_model.CHILD_STRENGTH + self.d * self.open[u]) * self.base(h)) / (language_model.CHILD_STRENGTH + count[u])


def test_scores_agree_with_a_plain_sampler(spark):
    rng = random.Random(8)
    likely = {w: rng.sample(WORDS, 4) for w in WORDS}

    def text():
        words = [rng.choice(WORDS)]
        while len(words) < 30:
            words.append(rng.choice(likely[words[-1]]) if rng.random() < 0.8 else rng.choice(WORDS))
        return " ".join(words)

    table = [(k, text()) for k in range(40)]
    fresh = [(100, text()), (101, "alpha unseen beta"), (102, " ".join(reversed(table[0][1].split())))]
    model = language_model.fit(spark.createDataFrame(table + fresh, "doc_id long, text string"), F.col("doc_id") < 100, sweeps=16, burn_in=6)
    got = {r["doc_id"]: r["score"] for r in language_model.score(model).collect()}
    pairs = Counter(b for _, t in table for b in bigrams(t))
    count = Counter()
    for (_, h), c in pairs.items():
        count[h] += c
    plain = Plain(pairs, model.totals.discount, model.totals.roots[0].discount, model.totals.v, 3)
    seen: dict = defaultdict(float)
    asked = {b for _, t in table[:5] + fresh for b in bigrams(t)}
    for k in range(60):
        plain.sweep()
        if k >= 20:
            for u, h in asked:
                seen[u, h] += plain.chance(u, h, count) / 40
    for i, t in table[:5] + fresh:
        assert got[i] == pytest.approx(sum(math.log10(seen[b]) for b in bigrams(t)), rel=0.02), i


def test_every_task_and_chunk_size_gives_the_same_counts(docs, monkeypatch):
    key = lambda m: sorted((repr(r["doc_id"]), r["n_tokens"], r["n_known"], round(r["base_score"], 6)) for r in language_model.score(m).collect())
    once = language_model.fit(docs, learn())
    whole, score = key(once), {r["doc_id"]: r["score"] for r in language_model.score(once).collect()}
    monkeypatch.setattr(common, "TEXT_ROWS_PER_BATCH", 3)
    monkeypatch.setattr(language_model, "CHUNK", 50)
    monkeypatch.setattr(language_model, "TASK_BYTES", 2500)
    cut = language_model.fit(docs, learn())
    assert cut.parts > 3 and cut.chunks.count() > 10 and key(cut) == whole
    assert all(r["score"] == pytest.approx(score[r["doc_id"]], rel=0.03) for r in language_model.score(cut).collect() if r["doc_id"] is not None)


def test_rare_words_open_restaurants(spark):
    rare = [f"rare{k}" for k in range(60)]
    order = [(k * 7 + 3) % 60 for k in range(60)]
    table = [(i, " ".join(f"{rare[k]} next{order[k]}" for k in range(60)) + " common" * (i % 3)) for i in range(40)]
    d = spark.createDataFrame(table + [(900, f"rare50 next{order[50]}"), (901, f"rare50 next{order[51]}")], "doc_id long, text string")
    model = language_model.fit(d, F.col("doc_id") < 900)
    scores = {r["doc_id"]: r["score"] for r in language_model.score(model).collect()}
    assert scores[900] > scores[901] + 1


def test_nothing_to_learn_from(spark, docs):
    model = language_model.fit(docs, F.lit(False))
    assert {r["score"] for r in language_model.score(model).collect()} == {0.0}
    assert language_model.score(language_model.fit(docs.limit(0), learn())).count() == 0


def weights(n, house):
    """Exact distribution of a dish's number of tables, from generalised Stirling numbers."""
    d, w, t, strength = house.discount, house.weight[0], house.tables[0], house.strength
    ways = [0.0, 1.0]
    for m in range(1, n):
        ways = [0.0] + [ways[k - 1] + (m - d * k) * (ways[k] if k <= m else 0.0) for k in range(1, m + 2)]
    p = np.array([ways[k] * math.prod(w * (strength + d * (t + j)) for j in range(k)) for k in range(1, n + 1)])
    return p / p.sum()


@pytest.mark.parametrize("n,discount", [(2, 0.5), (7, 0.7), (30, 0.3)])
def test_gibbs_steps_keep_the_exact_distribution(n, discount):
    many, rng = 20_000, np.random.default_rng(n)
    house = House(np.full(many, 0.08), np.full(many, 5.0), 1.5, discount)
    seats = arrive(Seats.empty(many), np.full(many, n), house, rng)
    for _ in range(150):
        seats = reseat(seats, house, rng)
    assert (seats.customers() == n).all() and (np.diff(seats.dish) >= 0).all()
    assert np.abs(np.bincount(seats.tables(), minlength=n + 1)[1:] / many - weights(n, house)).max() < 0.015


def test_arrivals_are_those_of_seating_one_by_one():
    n, many, rng = 8, 20_000, np.random.default_rng(0)
    house = House(np.full(many, 0.3), np.full(many, 4.0), 1.0, 0.6)
    shape = lambda s: Counter(tuple(sorted(part.tolist())) for part in np.split(s.size, np.searchsorted(s.dish, np.arange(1, many))))
    once = shape(arrive(Seats.empty(many), np.full(many, n), house, rng))
    twice = shape(arrive(arrive(Seats.empty(many), np.full(many, 3), house, rng), np.full(many, n - 3), house, rng))
    plain, r = Counter(), random.Random(1)
    for _ in range(many):
        tables = [1]
        while sum(tables) < n:
            new = 0.3 * (1.0 + 0.6 * (4 + len(tables)))
            k = r.choices(range(len(tables) + 1), [s - 0.6 for s in tables] + [new])[0]
            tables = [*tables, 1] if k == len(tables) else [s + (j == k) for j, s in enumerate(tables)]
        plain[tuple(sorted(tables))] += 1
    for k, c in plain.items():
        assert abs(c - once[k]) / many < 0.015 and abs(c - twice[k]) / many < 0.015


def test_leaving_takes_customers_at_random():
    many, rng = 20_000, np.random.default_rng(2)
    seats = Seats(many, np.repeat(np.arange(many), 3), np.tile([5, 1, 2], many))
    left = leave(seats, np.full(many, 4), rng)
    assert (left.customers() == 4).all()
    assert left.size.sum() == 4 * many and abs((left.tables() == 3).mean() - 25 / 70) < 0.02  # C(5,2) C(1,1) C(2,1) + C(5,1) C(2,2), of C(8,4)
    gone = leave(seats, np.full(many, 8), rng)
    assert len(gone.size) == 0


def test_words_are_cut_as_bytes_are():
    texts = [None, b"", b" \n", "A b\x0bc\u00a0d \x85É\x1c".encode(), b"x", b"\tY  y\r\n\x0cz "]
    words, counts = language_model._split(texts)
    assert words.to_pylist() == [w for t in texts for w in language_model.tokens(t)[:-1]]
    assert counts.tolist() == [len(language_model.tokens(t)) - 1 for t in texts]
    assert [len(x) for x in language_model._split([])] == [0, 0]


def test_bodies_come_back_as_packed():
    for a in (np.empty(0, np.int64), np.arange(5) * 70_000, np.array([1, 2**63 + 5], np.uint64), np.array([True, False]), np.array([[0.5, 1.25]])):
        back = posts.unpack(posts.pack(a))[0]
        assert np.array_equal(a, back) and a.shape == back.shape


@pytest.mark.parametrize("weight,tables,discount", [(0.5, 20, 0.7), (0.05, 3, 0.8), (0.9, 3, 0.8), (0.3, 300, 0.6)])
def test_a_sweep_seats_all_customers_of_large_dishes_anew(weight, tables, discount):
    n, many, rng = 150, 2000, np.random.default_rng(5)
    house = House(np.full(many, weight), np.full(many, float(tables)), 1.5, discount)
    exact = weights(n, house)
    for sizes in (np.array([n]), np.ones(n, np.int64)):  # all at one table, or each alone
        seats = Seats(many, np.repeat(np.arange(many), len(sizes)), np.tile(sizes, many))
        for _ in range(15):
            seats = reseat(seats, house, rng)
        assert (seats.customers() == n).all()
        got = np.bincount(seats.tables(), minlength=n + 1)[1:] / many
        assert np.abs(np.cumsum(got) - np.cumsum(exact)).max() < 0.05


def test_few_new_seatings_are_turned_down():
    rng = np.random.default_rng(6)
    for n, weight, tables in ((7, 0.08, 5), (1000, 0.01, 100), (100_000, 0.02, 3000)):
        house = House(np.full(200, weight), np.full(200, float(tables)), 5.0, 0.7)
        seats, _ = _anew(arrive(Seats.empty(200), np.full(200, n), house, rng), house, rng)
        took = np.mean([_anew(seats, house, rng)[1].mean() for _ in range(3)])
        assert took > 0.6
