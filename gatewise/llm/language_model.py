"""Scoring texts by a hierarchical Pitman-Yor model.

Restaurants: one for each word that something follows, and one for the start
of a text, serving what comes after; a root is their shared parent.  Below the
root lies a uniform base over the training words and one unknown word.

Seating is sampled by sweeps (see ``seating``): in each, all customers of every
dish of every restaurant get up and sit down again, given all other dishes;
tables opened or closed send customers to or from the root, whose dishes are
then reseated alike.  What other tasks do in the same sweep is seen a sweep
later.  The first state comes from seating all customers one after another.
Probabilities are averaged over the states of the sweeps after ``BURN_IN``.

A pair that occurs once has one customer and one table whatever happens, so
only pairs that occur more often have a state; tables of a restaurant and
customers of a dish are its occurrences less what those pairs save.

All documents, those learned from and those only scored, are read once, into
chunks of word numbers.  Pairs are dealt to tasks by a hash of both words and
words by a hash of the word (see ``posts``), so that no task's load depends on
how frequent a word, a pair or a restaurant is: a pair comes once from each
chunk.  The pair's task counts it, keeps its seating, and in the end answers
each chunk; the word's task keeps its restaurant's and its dish's totals.
Only scalars come to the driver, and nothing is broadcast.

Words go by their XXH64.

Defined results: a null or empty text is its end token alone; without training
tokens every probability is one; equal rows give equal rows; a null id is in
no way special but for its fold; other columns are ignored.
"""

from __future__ import annotations

import gc
import math
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship
from . import common, posts
from .posts import Inbox, Post, opened, post
from .seating import House, Seats, arrive, leave, reseat

HELD_OUT = 1
SWEEPS, BURN_IN = 7, 3
CHILD_STRENGTH, ROOT_STRENGTH = 5.0, 1.0
#: Tokens of a chunk, give or take a batch.
CHUNK = 2_000_000
#: Bytes of text for each task that keeps pairs.  Tasks write to each other: larger executors should have fewer.
TASK_BYTES = 20 << 20
#: Stands for the end of a text, and for what comes before its first word.  No word holds white space.
EDGE = b"\n"
WORD_SEED = 42


def tokens(text: bytes | None) -> list[bytes]:
    return [*(text or b"").lower().split(), EDGE]


_SPACE = np.zeros(256, bool)
_SPACE[[*range(9, 14), 32]] = True


def _split(texts: list[bytes | None]) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts, as ``tokens`` has them but for the ends, and how many each has."""
    lowered = [(t or b"").lower() for t in texts]
    ends = np.cumsum([len(t) + 1 for t in lowered])
    raw = np.frombuffer(b"\n".join([*lowered, b""]), np.uint8)  # a line feed behind each text
    space = _SPACE[raw]
    edge = np.flatnonzero(np.diff(space, prepend=True))  # starts and ends of words, in turn
    starts, stops = edge[::2], edge[1::2]
    offsets = np.concatenate([[0], np.cumsum(stops - starts)])
    words = pa.Array.from_buffers(
        pa.large_binary(), len(starts), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(raw[~space])]
    )
    return words, np.diff(np.searchsorted(starts, ends), prepend=0)


def _mix(x: np.ndarray) -> np.ndarray:
    """The SplitMix64 finaliser, which has an inverse: no two numbers meet."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _task(key: np.ndarray, parts: int) -> np.ndarray:
    """The task of a mixed key; it never falls as the key grows."""
    return ((key >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def _slices(keys: np.ndarray, parts: int) -> list[tuple[int, slice]]:
    """Tasks of sorted keys, with their ranges."""
    ends = np.searchsorted(_task(keys, parts), np.arange(parts + 1)).tolist()
    return [(k, slice(a, b)) for k, (a, b) in enumerate(zip(ends, ends[1:])) if a < b]


# -- chunks: documents as word numbers


def _numbered(words: pa.ChunkedArray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the distinct words, the most frequent first, tokens by number, and tokens per document."""
    coded = words.combine_chunks().dictionary_encode()
    at = coded.indices.to_numpy()
    order = np.argsort(-np.bincount(at, minlength=len(coded.dictionary)), kind="stable")
    number = np.empty(len(order), np.int64)
    number[order] = np.arange(1, len(order) + 1)
    names = coded.dictionary.to_pylist()
    hashes = [xxhash.xxh64_intdigest(EDGE, WORD_SEED), *(xxhash.xxh64_intdigest(names[k], WORD_SEED) for k in order)]
    tokens = np.zeros(len(at) + len(counts), np.int64)
    tokens[np.arange(len(at)) + np.repeat(np.arange(len(counts)), counts)] = number[at]
    return np.array(hashes, np.uint64), tokens, counts + 1


def read(docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Chunks of all documents: a post with a column ``ids``; the body has words, tokens, tokens per document, learned or not.

    Word 0 is ``EDGE``; each document ends with it.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(learn, F.lit(False)).alias("learn"), F.col(text_col).cast("binary").alias("t"))
    kind = rows.schema["id"].dataType
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, made, size = TaskContext.get().partitionId() << 32, 0, 0
        ids, learned, found, sizes = [], [], [], []

        def out() -> pa.RecordBatch:
            row = post("chunk", place + made, 0, *_numbered(pa.chunked_array(found), np.concatenate(sizes)), np.concatenate(learned))
            batch = posts.batch_of([row])
            every = pa.chunked_array(ids).combine_chunks()
            lists = pa.ListArray.from_arrays(pa.array([0, len(every)], pa.int32()), every)
            return pa.RecordBatch.from_arrays([*batch.columns, lists], [*batch.schema.names, "ids"])

        for batch in batches:
            words, counts = _split(batch.column(2).to_pylist())
            ids.append(batch.column(0))
            learned.append(batch.column(1).to_numpy(zero_copy_only=False))
            found.append(words)
            sizes.append(counts)
            size += len(words) + len(counts)
            if size >= CHUNK:
                yield out()
                made, size = made + 1, 0
                ids, learned, found, sizes = [], [], [], []
        if size:
            yield out()

    return common.durable(rows.mapInArrow(run, f"{posts.SCHEMA}, ids array<{kind.simpleString()}>"), "chunks")


def _ranks(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values in order, and which of them each value is."""
    order = np.argsort(values)
    ordered = values[order]
    new = np.concatenate([[True], ordered[1:] != ordered[:-1]])
    rank = np.empty(len(values), np.int64)
    rank[order] = np.cumsum(new) - 1
    return ordered[new], rank


class Chunk:
    """A chunk's tokens and distinct pairs; the pairs are ordered by their task, then by the numbers of their words."""

    def __init__(self, body: list[np.ndarray], parts: int):
        self.words, self.tokens, self.sizes, learned = body
        self.learned = np.repeat(learned, self.sizes)  #: by token
        n = len(self.words)
        code, rank = _ranks(np.concatenate([[0], self.tokens[:-1]]) * n + self.tokens)
        u, h = code // n, code % n
        task = _task(_mix(_mix(self.words)[u] + self.words[h]), parts)
        order = np.argsort(task.astype(np.min_scalar_type(parts)), kind="stable")
        self.u, self.h = u[order], h[order]
        self.ends = np.cumsum(np.bincount(task, minlength=parts))
        place = np.empty_like(order)
        place[order] = np.arange(len(order))
        self.pair = place[rank]  #: of each token
        self.by_word = np.argsort(_mix(self.words), kind="stable")  #: words, ordered by their mixed hash


def _named(words: np.ndarray, u: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words in use, the steps by which numbers of first words rise, and the numbers of second words."""
    if 8 * len(u) < len(words):
        used, rank = _ranks(np.concatenate([u, h]))
        u, h = rank[: len(u)], rank[len(u) :]
    else:
        there = np.zeros(len(words), bool)
        there[u] = there[h] = True
        used = np.flatnonzero(there)
        place = np.cumsum(there) - 1
        u, h = place[u], place[h]
    return words[used], np.diff(u, prepend=0), h


def _ask(parts: int, body: list[np.ndarray], chunk: int) -> list[Post]:
    """A chunk's pairs and words, with their counts among what is learned, for the tasks that keep them."""
    c = Chunk(body, parts)
    n = np.bincount(c.pair[c.learned], minlength=len(c.u))
    out = []
    for to, (a, b) in enumerate(zip([0, *c.ends[:-1].tolist()], c.ends.tolist())):
        if a < b:
            out.append(post("pairs", to, chunk, *_named(c.words, c.u[a:b], c.h[a:b]), n[a:b]))
    count = np.bincount(c.tokens[c.learned], minlength=len(c.words))[c.by_word]
    words = c.words[c.by_word]
    for to, s in _slices(_mix(words), parts):
        out.append(post("words", to, chunk, words[s], count[s]))
    return out


def _grouped(order: np.ndarray, new: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """From the places of rows in order and where groups begin: group of each row, place of each group's first row."""
    at = np.empty(len(order), np.int64)
    at[order] = np.cumsum(new) - 1
    return at, order[new]


def _answers(kind: str, to: int, senders: list[tuple[int, int]], index: np.ndarray) -> Iterator[Post]:
    ends = np.cumsum([0, *(n for _, n in senders)]).tolist()
    for (sender, _), a, b in zip(senders, ends, ends[1:]):
        yield post(kind, to, sender, index[a:b])


def _gather(to: int, inbox: Inbox) -> list[Post]:
    """Distinct pairs and words of a task, and where each chunk's are.

    A pair's index is 0 without occurrence among what is learned, 1 with one, else 2 and up.
    """
    out: list[Post] = []
    asked = opened(inbox, "pairs")
    if asked:
        u = np.concatenate([words[np.cumsum(steps)] for _, (words, steps, _, _) in asked])
        h = np.concatenate([words[at] for _, (words, _, at, _) in asked])
        n = np.concatenate([body[3] for _, body in asked])
        asked = [(chunk, len(body[3])) for chunk, body in asked]
        inbox.pop("pairs")
        key = _mix(_mix(u) + h)
        order = np.argsort(key)
        differs = lambda a: np.concatenate([[True], a[order][1:] != a[order][:-1]])
        if np.any(~differs(key) & (differs(u) | differs(h))):  # two pairs with one key
            order = np.lexsort((h, u, key))
        at, first = _grouped(order, differs(key) | differs(u) | differs(h))
        total = np.bincount(at, n, len(first)).astype(np.int64)
        many = total > 1
        index = np.where(many, np.cumsum(many) + 1, total)
        chosen = first[many]
        out.append(post("many", to, to, u[chosen], h[chosen], total[many], a=float((total == 1).sum()), b=float((total == 2).sum())))
        out += _answers("pair-index", to, asked, index[at])
    asked = opened(inbox, "words")
    if asked:
        w, n = (np.concatenate([body[k] for _, body in asked]) for k in (0, 1))
        order = np.argsort(_mix(w), kind="stable")
        at, first = _grouped(order, np.concatenate([[True], w[order][1:] != w[order][:-1]]))
        total = np.bincount(at, n, len(first)).astype(np.int64)
        out.append(post("vocabulary", to, to, w[first], total, a=float(total.sum()), b=float((total > 0).sum())))
        out.append(post("rare", to, to, a=float((total == 1).sum()), b=float((total == 2).sum())))
        out += _answers("word-index", to, [(s, len(b[1])) for s, b in asked], at)
    return out


# -- the sampler


def _random(side: int, sweep: int, task: int) -> np.random.Generator:
    """A task run again draws the same numbers."""
    return np.random.default_rng([side, sweep, task])


@dataclass
class Root:
    """A state's totals at the root, which turn a dish's own share into its probability."""

    v: int
    discount: float
    customers: float = 0.0
    tables: float = 0.0

    @property
    def base(self) -> float:
        return (ROOT_STRENGTH + self.discount * self.tables) / (self.v + 1)

    def probability(self, own: np.ndarray) -> np.ndarray:
        return (own + self.base) / (ROOT_STRENGTH + self.customers)


def _subscribe(parts: int, to: int, inbox: Inbox) -> list[Post]:
    """The words that a task's pairs meet, named once to the tasks that keep them; every pair has one table."""
    (_, (u, h, n)), = opened(inbox, "many")
    words, where = [], []
    for side in (u, h):
        distinct, inverse = np.unique(_mix(side), return_inverse=True)
        first = np.empty(len(distinct), np.int64)
        first[inverse] = np.arange(len(side))
        words.append(side[first])
        where.append(inverse)
    out = [post("state", to, to, n, *where, np.arange(len(n)), np.ones(len(n), np.int64), np.zeros(len(n), np.int64))]
    saved = [np.bincount(at, n - 1, len(w)).astype(np.int64) for at, w in zip(where, words)]
    for k, (side, w, s) in enumerate(zip(("restaurant", "dish"), words, saved)):
        for there, part in _slices(_mix(w), parts):
            out.append(post(side, there, to, w[part], s[part], a=float(s[part].sum()) if k else 0.0))
    return out


def _sweep(parts: int, discount: float, root: Root, sweep: int, keep: bool, to: int, inbox: Inbox) -> list[Post]:
    """The pairs of a task get a new state, given their restaurants and dishes as of the last one."""
    (_, (n, u, h, dish, size, taken)), = opened(inbox, "state")
    answers = {side: opened(inbox, f"{side}-answer") for side in ("restaurant", "dish")}
    there, share = (np.concatenate([body[0] for _, body in answers[side]]) for side in ("restaurant", "dish"))
    seats = Seats(len(n), dish, size)
    rng = _random(0, sweep, to)
    house = House(root.probability(share)[h], there[u] - seats.tables(), CHILD_STRENGTH, discount)
    if sweep == 0:
        seats = arrive(Seats.empty(len(n)), n, house, rng)
    seats = reseat(seats, house, rng)
    tables = seats.tables()
    if keep:
        taken = taken + tables
    out = [post("state", to, to, n, u, h, seats.dish, seats.size, taken)]
    for side, at in (("restaurant", u), ("dish", h)):
        saved = np.bincount(at, n - tables).astype(np.int64)
        end = 0
        for sender, (values,) in answers[side]:
            part = saved[end : end + len(values)]
            end += len(values)
            out.append(post(side, sender, to, part, a=float(part.sum()) if side == "dish" else 0.0))
    return out


def _serve(root: Root, sweep: int, keep: bool, to: int, inbox: Inbox) -> list[Post]:
    """The words of a task: tables of their restaurants, customers of their dishes at the root, who are seated there."""
    (_, (w, count)), = opened(inbox, "vocabulary")
    out, where = [], {}
    if sweep < 0:  # the words were named
        key = _mix(w)
        for side in ("restaurant", "dish"):
            where[side] = [(s, np.searchsorted(key, _mix(body[0]))) for s, body in opened(inbox, side)]
            out += [post(f"{side}-index", to, s, at) for s, at in where[side]]
    else:
        for side in ("restaurant", "dish"):
            where[side] = [(s, at) for s, (at,) in opened(inbox, f"{side}-index")]
    left = {}
    for side in ("restaurant", "dish"):
        left[side] = count.copy()
        for (_, at), (_, body) in zip(where[side], opened(inbox, side)):
            left[side][at] -= body[-1]  # each word once
    there, customers = left["restaurant"], left["dish"]
    rng = _random(1, sweep + 1, to)
    if sweep < 0:
        seats, kept = Seats.empty(len(w)), []
        before = np.full(len(w), float(root.v - 1))  # as if every other word had a table
    else:
        (_, (dish, size, *kept)), = opened(inbox, "root")
        seats = Seats(len(w), dish, size)
        before = root.tables - seats.tables()
    house = House(np.full(len(w), 1 / (root.v + 1)), before, ROOT_STRENGTH, root.discount)
    change = customers - seats.customers()
    seats = arrive(leave(seats, np.maximum(-change, 0), rng), np.maximum(change, 0), house, rng)
    seats = reseat(seats, house, rng)
    share = customers - root.discount * seats.tables()
    if keep:
        kept = [*kept, count - there, count - customers, seats.tables()]
    out.append(post("root", to, to, seats.dish, seats.size, *kept, a=float(customers.sum()), b=float(len(seats.dish))))
    for side, values in (("restaurant", there.astype(np.float64)), ("dish", share)):
        out += [post(f"{side}-answer", s, to, values[at]) for s, at in where[side]]
    return out


@dataclass
class Totals:
    """The scalars of a model."""

    n: int  #: training tokens
    v: int  #: distinct ones
    discount: float
    roots: list[Root] = field(default_factory=list)  #: of the states kept

    def state(self, root: Root, count: np.ndarray, less: np.ndarray, fewer: np.ndarray, tables: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """By word, in one state: what its restaurant leaves to the root, and the root's probability of its dish.

        ``less`` tables has the restaurant than customers, and the dish ``fewer`` customers at the root than occurrences.
        """
        back = (CHILD_STRENGTH + self.discount * (count - less)) / (CHILD_STRENGTH + count)
        return back, root.probability(count - fewer - root.discount * tables)


@dataclass
class Model:
    totals: Totals
    parts: int  #: tasks that pairs and words are dealt to
    chunks: DataFrame
    asked: posts.Table
    pairs: posts.Table | None = None
    words: posts.Table | None = None


# -- answers


def _tell(model: Totals, to: int, inbox: Inbox) -> list[Post]:
    """For each chunk: the numbers behind its pairs' and its words' probabilities, all states' in small whole numbers.

    A pair has its count and, over all states, what it has less in tables; a word its count, and by state what its
    restaurant's tables and its dish's customers are less, and its dish's tables.
    """
    out = []
    states = len(model.roots)
    found = opened(inbox, "state")
    n, taken = (found[0][1][0], found[0][1][-1]) if found else (np.empty(0, np.int64),) * 2
    n, less = np.concatenate([[0, 1], n]), np.concatenate([[0, 0], states * n - taken])
    for chunk, (at,) in opened(inbox, "pair-index"):
        out.append(post("own", chunk, to, n[at], less[at]))
    asked = opened(inbox, "word-index")
    if asked:
        (_, (_, count)), = opened(inbox, "vocabulary")
        (_, (_, _, *kept)), = opened(inbox, "root")
        for chunk, (at,) in asked:
            out.append(post("word", chunk, to, count[at], *(x[at] for x in kept)))
    return out


def fit(
    docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", sweeps: int = SWEEPS, burn_in: int = BURN_IN
) -> Model:
    """Learn from the documents for which ``learn`` holds; the model scores all of ``docs``."""
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length(F.col(text_col)))).first()[0] or 0
    parts = max(1, math.ceil(size / TASK_BYTES))
    chunks = read(docs, learn, id_col, text_col)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, body in zip(batch.column("to").to_pylist(), batch.column("body").to_pylist()):
                yield posts.batch_of(_ask(parts, posts.unpack(body), chunk))

    asked = posts.deal([chunks.drop("ids").mapInArrow(ask, posts.SCHEMA)], parts, _gather, "asked")
    rate = lambda one, two: min(0.95, max(0.1, one / max(1, one + 2 * two)))
    n, v = map(int, asked.total("vocabulary"))
    totals = Totals(n, v, rate(*asked.total("many")))
    root_discount = rate(*asked.total("rare"))
    if not v:
        totals.roots.append(Root(0, root_discount))
        return Model(totals, parts, chunks, asked)
    root = Root(v, root_discount)
    pairs = posts.deal([asked["many"]], parts, partial(_subscribe, parts), "pairs")
    named = words = posts.deal(
        [asked["vocabulary"], pairs["restaurant"], pairs["dish"]], parts, partial(_serve, root, -1, False), "words"
    )
    index = [named["restaurant-index"], named["dish-index"]]
    for sweep in range(sweeps):
        keep = sweep >= burn_in
        root = Root(v, root_discount, *words.total("root"))
        old, pairs = pairs, posts.deal(
            [pairs["state"], words["restaurant-answer"], words["dish-answer"]], parts,
            partial(_sweep, parts, totals.discount, root, sweep, keep), "pairs",
        )
        old.drop()
        old, words = words, posts.deal(
            [asked["vocabulary"], *index, words["root"], pairs["restaurant"], pairs["dish"]], parts,
            partial(_serve, root, sweep, keep), "words",
        )
        if old is not named:
            old.drop()
        if keep:
            totals.roots.append(Root(v, root_discount, *words.total("root")))
    named.drop()
    return Model(totals, parts, chunks, asked, pairs, words)


def score(model: Model, id_col: str = "doc_id") -> DataFrame:
    """Per document of the model: id, n_tokens, n_known, base_score, score (log10 probabilities of the whole text)."""
    chunks, asked, totals, parts = model.chunks, model.asked, model.totals, model.parts
    kind = chunks.schema["ids"].dataType.elementType.simpleString()
    known = [asked["pair-index"], asked["word-index"], asked["vocabulary"]]
    if model.pairs is None:  # nothing was learned
        state = chunks.sparkSession.createDataFrame([], posts.SCHEMA)
        root = posts.deal([asked["vocabulary"]], model.parts, _no_root, "words")
        known += [state, root["root"]]
    else:
        known += [model.pairs["state"], model.words["root"]]
    told = posts.deal(known, model.parts, partial(_tell, model.totals), "told")
    every = chunks
    for answers in (told["own"], told["word"]):
        every = every.unionByName(answers.withColumn("ids", F.lit(None)))
    norm = math.log10(totals.n + 0.5 * (totals.v + 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.disable()
        ids: dict[int, pa.Array] = {}

        def noted(batch: pa.RecordBatch) -> pa.RecordBatch:
            lists = batch.column("ids")
            for k, (what, to) in enumerate(zip(batch.column("kind").to_pylist(), batch.column("to").to_pylist())):
                if what == "chunk":
                    ids[to] = lists[k].values
            return batch

        for to, inbox in posts.inboxes(map(noted, batches)):
            yield _scored(inbox, ids.pop(to), parts, totals, norm, id_col)

    # chunk c of partition p has a task of its own, c + p * most
    most = (chunks.agg(F.max(F.col("to").bitwiseAND(F.lit(0xFFFFFFFF)))).first()[0] or 0) + 1
    task = (F.shiftright("to", 32) * most + F.col("to").bitwiseAND(F.lit(0xFFFFFFFF))).cast("int")
    tasks = (chunks.agg(F.max(task)).first()[0] or 0) + 1
    dealt = every.repartitionById(tasks, task).sortWithinPartitions("to", "kind", "sender")
    schema = f"`{id_col}` {kind}, n_tokens long, n_known long, base_score double, score double"
    result = common.durable(dealt.mapInArrow(run, schema), "scores")
    told.drop()
    return result


def _no_root(to: int, inbox: Inbox) -> list[Post]:
    """Root shares of a state in which nothing was learned."""
    (_, (w, count)), = opened(inbox, "vocabulary")
    zero, none = np.zeros(len(w), np.int64), np.empty(0, np.int64)
    return [post("root", to, to, none, none, zero, zero, zero)]


def _scored(inbox: Inbox, ids: pa.Array, parts: int, model: Totals, norm: float, id_col: str) -> pa.RecordBatch:
    (_, body), = opened(inbox, "chunk")
    c = Chunk(body, parts)
    n, less = (np.concatenate([b[k] for _, b in opened(inbox, "own")]) for k in (0, 1))
    told = opened(inbox, "word")

    def by_word(k: int) -> np.ndarray:
        out = np.empty(len(c.words), np.int64)
        out[c.by_word] = np.concatenate([b[k] for _, b in told])
        return out

    count, states = by_word(0), len(model.roots)
    own = n - model.discount * (n - less / states)
    chance = own / (CHILD_STRENGTH + count[c.u])
    for k, root in enumerate(model.roots):
        back, p = model.state(root, count, *(by_word(3 * k + j) for j in (1, 2, 3)))
        chance += back[c.u] * p[c.h] / states
    row = np.repeat(np.arange(len(c.sizes)), c.sizes)
    sums = lambda x: np.bincount(row, x, len(c.sizes))
    return pa.RecordBatch.from_arrays(
        [
            ids,
            pa.array(c.sizes, pa.int64()),
            pa.array(sums(count[c.tokens] > 0).astype(np.int64)),
            pa.array(sums(np.log10(count + 0.5)[c.tokens]) - c.sizes * norm),
            pa.array(sums(np.log10(chance)[c.pair])),
        ],
        [id_col, "n_tokens", "n_known", "base_score", "score"],
    )


def op8_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    model = fit(docs, common.fold_number(F.col("doc_id")) != HELD_OUT)
    return score(model).select(
        "doc_id",
        (common.fold_number(F.col("doc_id")) == HELD_OUT).alias("held_out"),
        "n_tokens",
        "n_known",
        F.lit(model.totals.n).cast("long").alias("train_tokens"),
        "base_score",
        "score",
        F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity"),
    )
