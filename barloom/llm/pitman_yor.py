"""Hierarchical Pitman-Yor language model over the words of a corpus.

A word is a dish and the word before it names a restaurant, whatever the number of words. Customers
are the corpus's tokens; each table of a context restaurant is a customer of the one restaurant that
all of them share as parent, whose own tables draw from a uniform base over the known words and one
unknown word.

Seating is sampled by Gibbs, given the parent's probabilities and the restaurants' numbers of tables
of the sweep before, so that the dishes of all restaurants move in parallel. All customers of a dish
leave and are seated again at once: the number of tables is drawn from its distribution, which needs
no sizes. The ways to sit at so many tables are tabulated for up to ``WHOLE`` customers and integrated
for more. The parent's dishes are drawn alike each sweep. Predictive probabilities are averaged over
the sweeps kept.

Words travel as 64-bit hashes, the most frequent ones (the dictionary, all counted exactly) as places.
Pairs of two dictionary words are dealt by pair, other pairs by the rare word; pairs of two rare words
by the dish, and the totals of their restaurants, which live where the context is dealt to, come from
there: for seating by a join each sweep, for scores by sending what the dish knows to the restaurant.
A bucket's rows are packed in arrays; buckets grow in number with the corpus, and one that gets more
rows than others is split by the texts' chunks. Only totals of bounded size (a number for each
dictionary word and its restaurant) come to the driver.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from contextlib import contextmanager
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm.common import give_back, ship
from barloom.session import materialize

DICTIONARY = 60_000
# Restaurants known by a place: the dictionary's and the one of first words. Hashes start beyond all places.
CONTEXTS = DICTIONARY + 1
FIRST = np.uint64(1 << 16)
STEP = 1 << 20
CHUNK = 4 << 20
WHOLE = 512
MOVES = 256
NODES = 16
BURN, KEPT = 2, 3
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
HEAD, PART, ASKED = 0, 1, 2
TYPES = -1
END = np.uint64(0)
_U = np.uint64


# ---- words as numbers -------------------------------------------------------------------------


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20_240)
    symbol = rng.integers(1, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)
    blank = np.zeros(256, bool)
    blank[[9, 10, 11, 12, 13, 32]] = True
    factor = _U(0x9E3779B97F4A7C15)
    inverse = _U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
    size = 2 * STEP + 1
    up, down = np.full(size, factor), np.full(size, inverse)
    up[0] = down[0] = 1
    return symbol, blank, np.cumprod(up), np.cumprod(down)


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> _U(33))
    x = x * _U(0xFF51AFD7ED558CCD)
    x = x ^ (x >> _U(33))
    x = x * _U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _U(33))


def _piece(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    symbol, blank, up, down = _tables()
    n = len(data)
    if n >= len(up):  # one word or more than twice the step without a blank to cut at
        up = np.cumprod(np.concatenate(([_U(1)], np.full(n, up[1]))))
        down = np.cumprod(np.concatenate(([_U(1)], np.full(n, down[1]))))
    space = blank[data]
    edge = np.diff(np.concatenate(([True], space, [True])).astype(np.int8))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    total = np.concatenate(([_U(0)], np.cumsum(symbol[data] * up[:n])))
    hashed = mix((total[ends] - total[starts]) * down[starts] ^ (ends - starts).astype(np.uint64) * _U(0xD6E8FEB86659FD93))
    hashed[hashed < FIRST] += FIRST
    return starts, hashed


def hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Start and hash of each word, in pieces cut at blanks."""
    whole = np.frombuffer(data, np.uint8)
    if len(whole) <= STEP:
        return _piece(whole)
    blank = _tables()[1]
    found, at = [], 0
    while at < len(whole):
        end = min(at + STEP, len(whole))
        while end < len(whole) and not blank[whole[end]]:
            ahead = np.flatnonzero(blank[whole[end : end + STEP]])
            end = end + int(ahead[0]) if len(ahead) else min(end + STEP, len(whole))
        s, h = _piece(whole[at:end])
        found.append((s + at, h))
        at = end
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def tokens(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word, document, whether first) of each token, ends included."""
    parts = [t.encode().lower() for t in texts]
    begin = np.cumsum([0] + [len(p) + 1 for p in parts])[:-1]
    starts, words = hashes(b" ".join(parts))
    doc = np.searchsorted(begin, starts, side="right") - 1
    sizes = np.bincount(doc, minlength=len(parts)) + 1
    stops = np.cumsum(sizes) - 1
    n = int(sizes.sum())
    out = np.full(n, END)
    inner = np.ones(n, bool)
    inner[stops] = False
    out[inner] = words
    first = np.zeros(n, bool)
    first[stops - sizes + 1] = True
    return out, np.repeat(np.arange(len(parts)), sizes), first


def chunks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows of a task in chunks of about equal bytes."""
    for b in batches:
        sizes = b["text"].str.len().to_numpy(np.int64)
        cut = np.concatenate(([0], np.cumsum(sizes)))[:-1] // CHUNK
        for _, part in b.groupby(cut, sort=False):
            yield part.reset_index(drop=True)


class Dictionary:
    def __init__(self, words: np.ndarray, counts: np.ndarray, total: int, types: int):
        order = np.argsort(words)
        self.words, self.counts, self.total, self.types = words[order], counts[order], total, types

    def find(self, words: np.ndarray) -> np.ndarray:
        if not len(self.words):
            return np.full(len(words), -1)
        at = np.minimum(np.searchsorted(self.words, words), len(self.words) - 1)
        return np.where(self.words[at] == words, at, -1)

    def coded(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(word, dictionary place or -1, restaurant, document) of each token; a restaurant is a place or the word's hash."""
        words, doc, first = tokens(texts)
        place = self.find(words)
        context = np.empty(len(words), np.uint64)
        context[1:] = np.where(place >= 0, place.astype(np.uint64), words)[:-1]
        context[first] = CONTEXTS - 1
        return words, place, context, doc


def pack(*arrays: np.ndarray) -> bytes:
    head = np.array([len(arrays), *[x for a in arrays for x in (len(a), ord(a.dtype.char))]], "<i8")
    return zlib.compress(head.tobytes() + b"".join(a.tobytes() for a in arrays), 1)


def unpack(blob: bytes) -> list[np.ndarray]:
    data = zlib.decompress(blob)
    n = int(np.frombuffer(data, "<i8", 1)[0])
    head = np.frombuffer(data, "<i8", 1 + 2 * n)[1:]
    out, at = [], 8 * (1 + 2 * n)
    for k, kind in zip(head[::2].tolist(), head[1::2].tolist(), strict=True):
        out.append(np.frombuffer(data, np.dtype(chr(kind)), k, at))
        at += out[-1].nbytes
    return out


def _weighed(at: np.ndarray, weights: np.ndarray, size: int) -> np.ndarray:
    """Sums of weights by place, as floating point numbers also where there are none."""
    return np.bincount(at, weights, minlength=size).astype(np.float64)


def _runs(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order by the keys and starts of runs of equal keys; the first key counts most."""
    order = np.lexsort(keys[::-1])
    change = np.zeros(len(order), bool)
    for k in keys:
        s = k[order]
        change[1:] |= s[1:] != s[:-1]
    if len(change):
        change[0] = True
    return order, np.flatnonzero(change)


def _sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    return np.add.reduceat(values, starts) if len(starts) else values[:0]


# ---- vocabulary --------------------------------------------------------------------------------


def learn_words(docs: DataFrame, size: int = DICTIONARY) -> Dictionary:
    """Exact numbers of tokens and types, and the most frequent words with their exact counts."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def merged():
            words, counts = (np.concatenate(x) for x in zip(*held, strict=True))
            order, starts = _runs(words)
            return words[order][starts], _sums(counts[order], starts)

        for part in chunks(batches):
            words = tokens(list(part["text"]))[0]
            held.append(np.unique(words, return_counts=True))
            if sum(len(w) for w, _ in held) > 2_000_000:
                held = [merged()]
                if len(held[0][0]) > 1_000_000:
                    yield pd.DataFrame({"word": held[0][0].view(np.int64), "n": held[0][1]})
                    held = []
        if held:
            words, counts = merged()
            yield pd.DataFrame({"word": words.view(np.int64), "n": counts})
        give_back()

    found = docs.select("text").mapInPandas(count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    # Frequencies in steps of a sixteenth of a power of two.
    found = materialize(found.withColumn("step", F.floor(F.log2("n") * 16).cast("int")), "vocabulary")
    steps = sorted(found.groupBy("step").agg(F.count("*").alias("types"), F.sum("n").alias("total")).collect(), key=lambda r: -r["step"])
    lowest, room = None, size
    for r in steps:
        room -= r["types"]
        if room < 0:
            break
        lowest = r["step"]
    total, types = sum(r["total"] for r in steps), sum(r["types"] for r in steps)
    rows = found.where(F.col("step") >= lowest).select("word", "n").toPandas() if lowest is not None else pd.DataFrame({"word": [], "n": []})
    return Dictionary(rows["word"].to_numpy(np.int64).view(np.uint64), rows["n"].to_numpy(np.int64), int(total), int(types))


# ---- seating -----------------------------------------------------------------------------------


@lru_cache(maxsize=2)
def _ways(discount: float) -> np.ndarray:
    """Logs of the weights of all ways that c customers (row) sit at t tables (column), a seat weighing a table's size less the discount."""
    out = np.full((WHOLE + 1, WHOLE + 1), -np.inf)
    out[1, 1] = 0.0
    t = np.arange(1, WHOLE + 1)
    for c in range(1, WHOLE):
        out[c + 1, 1:] = np.logaddexp(out[c, :-1], out[c, 1:] + np.log(np.maximum(c - discount * t, 1e-300)))
    return out


def _odds(c: int, weight: np.ndarray, more: np.ndarray, discount: float) -> np.ndarray:
    """Sums of the odds of 1, 2, ... c tables, a row for each weight."""
    logs = np.cumsum(np.log(weight[:, None] + more[:, None] * np.arange(c)), axis=1) + _ways(discount)[c, 1 : c + 1]
    return np.cumsum(np.exp(logs - logs.max(axis=1, keepdims=True)), axis=1)


def _equal(values: np.ndarray) -> list[np.ndarray]:
    """Places of each distinct value."""
    order = np.argsort(values, kind="stable")
    return np.split(order, np.flatnonzero(np.diff(values[order])) + 1) if len(order) else []


def _log_gamma(x: np.ndarray) -> np.ndarray:
    y, shift = x.astype(np.float64), np.zeros(x.shape)
    for _ in range(8):
        low = y < 8
        shift += np.log(np.where(low, y, 1.0))
        y = np.where(low, y + 1, y)
    z = 1 / (y * y)
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + (1 / 12 - z * (1 / 360 - z * (1 / 1260 - z / 1680))) / y - shift


def log_ways(c: np.ndarray, t: np.ndarray, discount: float) -> np.ndarray:
    """What ``_ways`` tabulates, for any number of customers and also between whole numbers of tables.

    The ways of c customers are c! / t! times the c-th coefficient of ((1 - (1 - x)^discount) / discount)^t. With
    x = exp(-q) that is an integral along a parabola around the branch cut of q, laid through the saddle point; where
    it lies beyond 1, along a vertical line.
    """
    c, t = np.broadcast_arrays(np.asarray(c, np.float64), np.asarray(t, np.float64))
    alone, t = t > c - 0.5, np.minimum(t, c - 0.5)
    low, high = np.full(c.shape, -80.0), np.full(c.shape, 40.0)
    for _ in range(18):  # the saddle, as log odds of 1 - exp(-q)
        mid = (low + high) / 2
        y = -np.logaddexp(0, -mid)
        up = np.log(c / discount) + np.log(-np.expm1(discount * y)) + (1 - discount) * y + np.logaddexp(0, mid) < np.log(t)
        low, high = np.where(up, mid, low), np.where(up, high, mid)
    at = np.maximum(np.logaddexp(0, (low + high) / 2), 2 / c)
    y = -np.expm1(-at)
    g = np.where(at > 30, np.exp(-at), (1 - y**discount) / discount)
    first = -(y ** (discount - 1)) * np.exp(-at) / g
    second = t * (np.exp(-at) * ((1 - discount) * y ** (discount - 2) * np.exp(-at) + y ** (discount - 1)) / g - first * first)
    bend = (at <= 1).astype(np.float64)
    step = 0.4 / np.sqrt(np.maximum(4 * at**2 * second + 2 * bend * at * np.maximum(c + t * first, 0), 1e-300))
    whole = np.pi / (2 * at * NODES)  # the vertical line is a circle of x, gone round where the integrand does not fade
    step = np.where((bend == 0) & (step > 0.6 * whole), whole, step)
    theta = step[..., None] * (np.arange(NODES) + 0.5)
    q = at[..., None] * (1 + 2j * theta - bend[..., None] * theta**2)
    logs = t[..., None] * np.log((1 - (-np.expm1(-q)) ** discount) / discount) + c[..., None] * q
    top = logs[..., 0].real
    total = (np.exp(logs - top[..., None]) * (1 + 1j * bend[..., None] * theta)).real.sum(axis=-1) * step * 2 * at / np.pi
    return np.where(alone, 0.0, _log_gamma(c + 1) - _log_gamma(t + 1) + top + np.log(np.maximum(total, 1e-300)))


def _log_odds(c: np.ndarray, t: np.ndarray, weight: np.ndarray, more: np.ndarray, discount: float) -> np.ndarray:
    """Logs of the odds of t tables (a row for each dish) for many customers."""
    per = np.where(more > 0, weight / np.maximum(more, 1e-300), 1.0)
    rising = np.where(more > 0, t * np.log(np.maximum(more, 1e-300)) + _log_gamma(per + t) - _log_gamma(per), t * np.log(weight))
    return log_ways(c, t, discount) + rising


def draw_many(customers: np.ndarray, weight: np.ndarray, more: np.ndarray, discount: float, u: np.ndarray) -> np.ndarray:
    """``draw_tables`` of dishes with more than ``WHOLE`` customers."""
    out = np.ones(len(customers), np.int64)
    for i in range(0, len(customers), 256):
        part = np.arange(i, min(i + 256, len(customers)))
        c, w, m = (x[part].astype(np.float64)[:, None] for x in (customers, weight, more))
        f = _log_odds(c, np.arange(1.0, 17.0)[None, :], w, m, discount)
        odds = np.cumsum(np.exp(f - f.max(axis=1, keepdims=True)), axis=1)
        out[part] = np.minimum(1 + (odds < u[part, None] * odds[:, -1:]).sum(axis=1), 16)
        # The odds are log-concave: those that have not faded by 16 tables have their bulk beyond.
        beyond = np.flatnonzero(f[:, -1] > f.max(axis=1) - 25)
        if len(beyond):
            out[part[beyond]] = _draw_around(c[beyond], w[beyond], m[beyond], discount, u[part[beyond]])
    return np.minimum(out, customers.astype(np.int64))


def _draw_around(c: np.ndarray, w: np.ndarray, m: np.ndarray, discount: float, u: np.ndarray) -> np.ndarray:
    """The most likely number of tables is searched for; odds are taken at 33 places around it and interpolated between them."""
    out, rows, low, high = np.ones(len(c), np.int64), np.arange(len(c)), np.zeros(c.shape), np.log(c)
    for _ in range(2):
        logs = low + (high - low) * np.linspace(0, 1, 14)
        f = _log_odds(c, np.exp(logs), w, m, discount)
        k = np.clip(f.argmax(axis=1), 1, 12)
        low, high = logs[rows, k - 1][:, None], logs[rows, k + 1][:, None]
    bend = np.maximum(2 * f[rows, k] - f[rows, k - 1] - f[rows, k + 1], 1e-9)[:, None]
    lean = np.clip((f[rows, k + 1] - f[rows, k - 1])[:, None] / 2 / bend, -1, 1)
    best = np.exp((low + high) / 2 + lean * (high - low) / 2)
    span = 9 * best * (high - low) / 2 / np.sqrt(bend) + 5
    while True:
        low, high = np.maximum(np.floor(best - span), 1), np.minimum(np.ceil(best + span), c)
        step = np.maximum((high - low) / 32, 1)
        t = low + step * np.arange(33)
        f = np.where(t <= c, _log_odds(c, np.minimum(t, c), w, m, discount), -np.inf)
        top = f.max(axis=1)
        short = ((low[:, 0] > 1) & (f[:, 0] > top - 30)) | ((t[:, -1] < c[:, 0]) & (f[:, -1] > top - 30))
        if not short.any():
            break
        span = np.where(short[:, None], 2 * span, span)
    for j in rows:
        if step[j, 0] > 1:
            x = np.arange(int(high[j, 0] - low[j, 0]) + 1) / step[j, 0]
            k = np.clip(x.astype(np.int64), 1, 30)
            z, y = x - k, f[j] - top[j]
            odds = (y[k - 1] * -z * (z - 1) * (z - 2) + y[k] * 3 * (z + 1) * (z - 1) * (z - 2) - y[k + 1] * 3 * (z + 1) * z * (z - 2) + y[k + 2] * (z + 1) * z * (z - 1)) / 6
        else:
            odds = f[j] - top[j]
        odds = np.cumsum(np.exp(odds))
        out[j] = int(low[j, 0]) + int((odds < u[j] * odds[-1]).sum())
    return out


def draw_tables(customers: np.ndarray, weight: np.ndarray, more: np.ndarray, discount: float, u: np.ndarray) -> np.ndarray:
    """Tables of dishes, all of whose customers leave and are seated again at once.

    Drawn by ``u`` from the distribution given all other seats; a dish's k-th table weighs ``weight + (k - 1) * more``.
    """
    out = np.minimum(customers, 1)
    for same in _equal(np.minimum(customers, WHOLE + 1)):
        c = int(customers[same[0]])
        if c > WHOLE:
            out[same] = draw_many(customers[same], weight[same], more[same], discount, u[same])
            continue
        step = max(1, (1 << 18) // max(c, 1))
        for i in range(0, len(same) if c > 1 else 0, step):
            at = same[i : i + step]
            odds = _odds(c, weight[at], more[at], discount)
            out[at] = np.minimum(1 + (odds < u[at, None] * odds[:, -1:]).sum(axis=1), c)
    return out


def parent_tables(words: np.ndarray, customers: np.ndarray, sample: int, weight: float, discount: float) -> np.ndarray:
    """Tables of the parent for each dish, drawn by the words and the sample, so that every worker that holds
    the dishes draws the same."""
    t = np.minimum(customers, 1).astype(np.float64)
    u = mix(words ^ mix(np.array([sample + 1], np.uint64))) / 2.0**64
    for at in _equal(np.minimum(customers, WHOLE + 1).astype(np.int64)):
        c = int(customers[at[0]])
        if c > WHOLE:
            t[at] = draw_many(customers[at], np.full(len(at), weight), np.zeros(len(at)), discount, u[at])
        elif c > 1:
            odds = _odds(c, np.array([weight]), np.zeros(1), discount)[0]
            t[at] = np.minimum(1 + np.searchsorted(odds, u[at] * odds[-1]), c)
    return t


# ---- one customer at a time: seats with the sizes of tables, which the draws are held against


def openings(customers: np.ndarray, seated: np.ndarray, tables: np.ndarray, weight: np.ndarray, discount: float, rng: np.random.Generator) -> list[tuple[np.ndarray, np.ndarray]]:
    """Customers beyond those seated are seated one by one: (dishes, customers seated by then) of each next table opened.

    Each opens a table by ``weight`` against the number seated less the discount of each table. How many
    join tables before one opens is drawn at once: geometric, with a chance that is beta distributed.
    """
    n, t = seated.astype(np.int64), tables.astype(np.int64)
    at, found = np.flatnonzero(customers > n), []
    while len(at):
        p = rng.beta(np.maximum(weight[at], 1e-12), n[at] - discount * t[at])
        n[at] += np.minimum(rng.geometric(np.maximum(p, 1e-15)), 1 << 50)
        at = at[n[at] <= customers[at]]
        t[at] += 1
        found.append((at, n[at]))
        at = at[n[at] < customers[at]]
    return found


def first_seating(customers: np.ndarray, weight: np.ndarray, discount: float, rng: np.random.Generator) -> Seating:
    """All customers of each dish seated one by one."""
    one = np.ones(len(customers), np.int64)
    found = openings(customers, one, one, weight, discount, rng)
    left, dishes, sizes = customers.astype(np.int64), [], []
    # Who joined the last table opened is a beta-binomial number; the others sat as if it had not been there.
    for k in range(len(found) - 1, -1, -1):
        at, n = found[k]
        sizes.append(1 + rng.binomial(left[at] - n, rng.beta(1 - discount, n - 1 - discount * (k + 1))))
        left[at] -= sizes[-1]
        dishes.append(at)
    dish, size = np.concatenate([np.arange(len(left)), *dishes]), np.concatenate([left, *sizes])
    return Seating(size[np.argsort(dish, kind="stable")], np.bincount(dish, minlength=len(left)))


class Seating:
    """Tables of many dishes in one flat array, dishes with more customers first; each has free places for new tables."""

    def __init__(self, sizes: np.ndarray, tables: np.ndarray):
        self.sizes, self.tables = sizes.astype(np.int64), tables.astype(np.int64)

    def spare(self, extra: np.ndarray) -> None:
        room = self.tables + extra
        self.starts = np.concatenate(([0], np.cumsum(room)))
        flat = np.zeros(int(self.starts[-1]), np.int64)
        inside = np.arange(len(self.sizes)) - np.repeat(np.cumsum(self.tables) - self.tables, self.tables)
        flat[np.repeat(self.starts[:-1], self.tables) + inside] = self.sizes
        self.sizes, self.used = flat, self.starts[:-1] + self.tables

    def close(self) -> None:
        taken = self.sizes > 0
        cum = np.concatenate(([0], np.cumsum(taken)))
        self.tables = cum[self.starts[1:]] - cum[self.starts[:-1]]
        self.sizes = self.sizes[taken]

    def leave(self, first: int, rng: np.random.Generator) -> None:
        """One customer of each of the first dishes, any with equal chance, leaves."""
        starts = self.starts[: first + 1]
        cum = np.concatenate(([0], np.cumsum(self.sizes[: starts[-1]])))
        low = cum[starts[:-1]]
        pick = low + (rng.random(first) * (cum[starts[1:]] - low)).astype(np.int64)
        at = np.searchsorted(cum, pick, side="right") - 1
        self.closed = self.sizes[at] == 1
        self.sizes[at] -= 1

    def sit(self, first: int, weight: np.ndarray, discount: float, rng: np.random.Generator) -> None:
        """One customer of each of the first dishes joins a table by its size less the discount, or opens one."""
        starts = self.starts[: first + 1]
        sizes = self.sizes[: starts[-1]]
        cum = np.concatenate(([0.0], np.cumsum(np.where(sizes > 0, sizes - discount, 0.0))))
        low = cum[starts[:-1]]
        old = cum[starts[1:]] - low
        u = rng.random(first) * (weight + old)
        at = np.searchsorted(cum, low + np.maximum(u - weight, 0.0), side="right") - 1
        at = np.clip(at, starts[:-1], starts[1:] - 1)
        opens = (u < weight) | (sizes[at] == 0)
        self.sizes[at[~opens]] += 1
        new = np.flatnonzero(opens)
        self.sizes[self.used[new]] = 1
        self.used[new] += 1

    def sweep(self, customers: np.ndarray, weight: np.ndarray, discount: float, rng: np.random.Generator, lost: np.ndarray) -> None:
        """Up to ``MOVES`` customers of each dish are seated again; ``lost`` is a table's part of the weight."""
        self.spare(np.minimum(customers, MOVES))
        for k in range(MOVES):
            first = int((customers > k).sum())
            if not first:
                break
            self.leave(first, rng)
            self.sit(first, np.maximum(weight[:first] - np.where(self.closed, lost[:first], 0.0), 1e-12), discount, rng)
        self.close()


# ---- model


class Model:
    """What all workers need: the dictionary, discounts, and the restaurants' totals of each kept sweep."""

    def __init__(self, words: Dictionary, strength: float = 1.0):
        self.words, self.strength, self.parent_strength = words, strength, strength
        self.base = 1.0 / (words.types + 1)
        self.discount = self.parent_discount = 0.75
        self.customers = np.zeros(CONTEXTS)
        self.tables: list[np.ndarray] = []
        self.parent: list[np.ndarray] = []
        self.opening: list[float] = []
        self.seats: list[float] = []

    @property
    def parent_weight(self) -> float:
        return (self.parent_strength + self.parent_discount * self.words.types) * self.base

    def parent_chance(self, customers: np.ndarray, tables: np.ndarray, s: int) -> np.ndarray:
        return (customers - self.parent_discount * tables + self.opening[s] * self.base) / (self.parent_strength + self.seats[s])

    def add(self, totals: np.ndarray, sample: int) -> None:
        """Take over a sweep's totals: tables by restaurant and by dictionary word, rare dishes' seats and tables."""
        n = len(self.words.words)
        tables, seats = totals[:CONTEXTS], totals[CONTEXTS : CONTEXTS + n]
        rare_seats, rare_tables = totals[CONTEXTS + n :]
        own = parent_tables(self.words.words, seats, sample, self.parent_weight, self.parent_discount)
        self.tables.append(tables)
        self.seats.append(float(seats.sum() + rare_seats))
        self.opening.append(self.parent_strength + self.parent_discount * float(own.sum() + rare_tables))
        self.parent.append(self.parent_chance(seats, own, -1))

    def only(self, s: int) -> Model:
        one = Model(self.words, self.strength)
        one.__dict__ |= self.__dict__ | {k: [getattr(self, k)[s]] for k in ("tables", "parent", "opening", "seats")}
        return one


# ---- buckets -----------------------------------------------------------------------------------


def _deal(place, words, context, doc, buckets: int, salts: dict[int, int], salt: int) -> Iterator[tuple[int, bytes]]:
    """Packed rows of a chunk by bucket: pairs of dictionary words by pair, the others by the rare word, of two by the dish."""
    known, near = place >= 0, context < FIRST
    both, after = known & near, known & ~near
    pairs = place[both].astype(np.uint64) << _U(16) | context[both]
    key = pairs << _U(16) | doc[both].astype(np.uint64)
    key, n = np.unique(key, return_counts=True)
    pairs, pair_doc = key >> _U(16), (key & _U(0xFFFF)).astype(np.uint16)
    to = (mix(pairs) % _U(buckets)).astype(np.int64)
    order = np.argsort(to, kind="stable")
    a = (pairs[order].astype(np.uint32), pair_doc[order], n[order].astype(np.uint32))
    a_to = to[order]

    def dealt(by, other, doc):
        order, starts = _runs(by, other, doc)
        n = np.diff(np.append(starts, len(by))).astype(np.uint32)
        by, other, doc = by[order][starts], other[order][starts], doc[order][starts]
        to = (by % _U(buckets)).astype(np.int64)
        order = np.argsort(to, kind="stable")
        return (by[order], other[order], doc[order], n[order]), to[order]

    b, b_to = dealt(words[~known], context[~known], doc[~known].astype(np.uint16))
    c, c_to = dealt(context[after], place[after].astype(np.uint16), doc[after].astype(np.uint16))
    present = np.unique(np.concatenate((a_to, b_to, c_to)))
    cuts = [[np.searchsorted(x, present, side=side).tolist() for side in ("left", "right")] for x in (a_to, b_to, c_to)]
    for k, a0, a1, b0, b1, c0, c1 in zip(present.tolist(), *cuts[0], *cuts[1], *cuts[2], strict=True):
        yield k, salt % salts.get(k, 1), pack(*[x[a0:a1] for x in a], *[x[b0:b1] for x in b], *[x[c0:c1] for x in c])


def _rare_key(words: np.ndarray, context: np.ndarray) -> np.ndarray:
    return mix(words ^ mix(context.astype(np.uint64) + _U(0x5851F42D4C957F2D)))


def _merge(blobs) -> bytes:
    """Customers by pair: dictionary pairs in order, rare words ordered by word and restaurant, and dictionary words by rare restaurant."""
    parts = [unpack(b) for b in blobs]
    pairs, n, w, c, m, after, follow, k = (np.concatenate([p[i] for p in parts]) for i in (0, 2, 3, 4, 6, 7, 8, 10))
    order, starts = _runs(pairs)
    pairs, n = pairs[order][starts], _sums(n[order].astype(np.int64), starts)
    order, starts = _runs(w, c)
    w, c, m = w[order][starts], c[order][starts], _sums(m[order].astype(np.int64), starts)
    order, starts = _runs(after, follow)
    after, follow, k = after[order][starts], follow[order][starts], _sums(k[order].astype(np.int64), starts)
    return pack(pairs, n, w, c, m, after, follow, k)


def _found(keys: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in sorted keys, and which are there."""
    if not len(keys):
        return np.zeros(len(asked), np.int64), np.zeros(len(asked), bool)
    at = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
    return at, keys[at] == asked


class Types:
    """A bucket's pairs: restaurant, dish and customers; first pairs of dictionary words, then rare words, then dictionary
    words after rare ones. ``rare`` are the restaurants without a place."""

    def __init__(self, blob: bytes):
        self.pairs, n, self.words, before, m, *more = unpack(blob)
        self.after, follow, k = more or (np.empty(0, np.uint64), np.empty(0, np.uint16), np.empty(0, np.int64))
        self.before = before.astype(np.uint64)
        self.rows, self.late = slice(len(self.pairs), len(self.pairs) + len(self.words)), len(self.pairs) + len(self.words)
        far = self.before >= FIRST
        starts = np.flatnonzero(np.concatenate(([True], self.after[1:] != self.after[:-1]))) if len(self.after) else np.empty(0, np.int64)
        late = np.diff(np.append(starts, len(self.after)))
        self.rare = np.union1d(self.after[starts], self.before[far])
        at = np.where(far, 0, self.before).astype(np.int64)
        at[far] = CONTEXTS + np.searchsorted(self.rare, self.before[far])
        after = np.repeat(np.searchsorted(self.rare, self.after[starts]), late)
        self.context = np.concatenate(((self.pairs & 0xFFFF).astype(np.int64), at, CONTEXTS + after))
        # In order, as restaurants and dishes are.
        self.late_key = after << 16 | follow.astype(np.int64)
        self.customers = np.concatenate((n, m, k))
        starts = np.flatnonzero(np.concatenate(([True], self.words[1:] != self.words[:-1]))) if len(self.words) else np.empty(0, np.int64)
        self.dishes = self.words[starts]
        self.dish = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(self.words))))
        self.place, self.follow = (self.pairs >> 16).astype(np.int64), follow.astype(np.int64)
        many = np.flatnonzero(self.customers > 1)
        self.many = many[np.argsort(-self.customers[many], kind="stable")]

    def tables(self, seated: np.ndarray) -> np.ndarray:
        t = np.minimum(self.customers, 1)
        t[self.many] = seated
        return t

    def seats(self, tables: np.ndarray) -> np.ndarray:
        """Parent's customers of each dish beyond the dictionary."""
        return _weighed(self.dish, tables[self.rows], len(self.dishes))

    def chance(self, model: Model, s: int, tables: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Parent's probability of each pair's dish, and of each dish beyond the dictionary."""
        rare = self.rare_chance(model, s, tables)
        return np.concatenate((model.parent[s][self.place], rare[self.dish], model.parent[s][self.follow])), rare

    def rare_chance(self, model: Model, s: int, tables: np.ndarray) -> np.ndarray:
        seats = self.seats(tables)
        own = parent_tables(self.dishes, seats, s, model.parent_weight, model.parent_discount)
        return model.parent_chance(seats, own, s)

    def totals(self, model: Model, tables: np.ndarray, sample: int) -> np.ndarray:
        seats = self.seats(tables)
        own = parent_tables(self.dishes, seats, sample, model.parent_weight, model.parent_discount)
        n, near = len(model.words.words), self.context < CONTEXTS
        return np.concatenate((
            _weighed(self.context[near], tables[near], CONTEXTS),
            _weighed(self.place, tables[: len(self.pairs)], n) + _weighed(self.follow, tables[self.late :], n),
            [seats.sum(), own.sum()],
        ))

    def far(self) -> tuple[np.ndarray, ...]:
        """Rare words in rare restaurants: restaurants, customers, dishes with one and with several customers."""
        far = self.before >= FIRST
        rooms, at = np.unique(self.before[far], return_inverse=True)
        n = self.customers[self.rows][far]
        return rooms, *(np.bincount(at, w, len(rooms)).astype(np.int64) for w in (n, n == 1, n > 1))

    def rooms(self, asked: np.ndarray, rooms: Rooms, tables: np.ndarray, answer: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        """Tables of rare restaurants dealt to this bucket, and of others that were asked for."""
        at, there = _found(asked, self.after)
        out = _weighed(at[there], tables[self.late :][there], len(asked))
        at, there = _found(rooms.words, asked)
        out[there] += rooms.singles[at[there]]
        at, there = _found(answer[0], asked)
        out[there] = answer[1][at[there]]
        return out

    def mail(self, rooms: Rooms, tables: np.ndarray) -> bytes:
        """What this bucket adds to the tables of restaurants whose dishes several buckets seat."""
        far = (self.before >= FIRST) & (self.customers[self.rows] > 1)
        name, at = np.unique(self.before[far], return_inverse=True)
        own = rooms.words[rooms.shared]
        return pack(
            np.concatenate((name, own)),
            np.concatenate((_weighed(at, tables[self.rows][far], len(name)), self.rooms(own, rooms, tables, NO_ANSWER))).astype(np.int64),
        )


class Rooms:
    """Rare restaurants dealt to a bucket, in which other buckets seat rare words: customers, dishes of one customer, and
    whether the tables of others vary."""

    def __init__(self, blob):
        self.words, self.customers, self.singles, self.shared = unpack(blob) if _given(blob) else [np.empty(0, t) for t in (np.uint64, np.int64, np.int64, bool)]


NO_ANSWER = (np.empty(0, np.uint64), np.empty(0, np.int64))


def _given(blob) -> bool:
    return isinstance(blob, bytes | bytearray | memoryview)


def _answer(blob) -> tuple[np.ndarray, np.ndarray]:
    return tuple(unpack(blob)) if _given(blob) else NO_ANSWER


def _answers(mail: DataFrame, asks: DataFrame) -> DataFrame:
    """(bucket, answer): the summed tables of the restaurants each bucket asks for."""

    def opened(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for blob in b["mail"]:
                room, n = unpack(blob)
                yield pd.DataFrame({"room": room.view(np.int64), "n": n})

    def packed(rows: pd.DataFrame) -> pd.DataFrame:
        room = rows["room"].to_numpy(np.int64).view(np.uint64)
        order = np.argsort(room)
        return pd.DataFrame({"bucket": rows["bucket"].iloc[:1], "answer": [pack(room[order], rows["n"].to_numpy(np.int64)[order])]})

    found = mail.select("mail").mapInPandas(opened, "room long, n long").groupBy("room").agg(F.sum("n").alias("n"))
    return asks.join(found, "room").groupBy("bucket").applyInPandas(packed, "bucket int, answer binary")


def _rare_rooms(types: DataFrame, buckets: int) -> tuple[DataFrame, DataFrame]:
    """Rare restaurants with rare dishes by the bucket they are dealt to, and which buckets ask for which of them."""

    def opened(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for bucket, blob in zip(b["bucket"], b["far"], strict=True):
                rooms, n, singles, several = unpack(blob)
                yield pd.DataFrame({
                    "bucket": (rooms % _U(buckets)).astype(np.int32), "asker": np.int32(bucket), "room": rooms.view(np.int64),
                    "n": n, "singles": singles, "several": several,
                })

    def packed(rows: pd.DataFrame) -> pd.DataFrame:
        words, at = np.unique(rows["room"].to_numpy(np.int64).view(np.uint64), return_inverse=True)
        n, singles, several = (np.bincount(at, rows[k], len(words)).astype(np.int64) for k in ("n", "singles", "several"))
        return pd.DataFrame({"bucket": rows["bucket"].iloc[:1], "rooms": [pack(words, n, singles, several > 0)]})

    far = types.select("bucket", "far").mapInPandas(opened, "bucket int, asker int, room long, n long, singles long, several long")
    rooms = materialize(far.groupBy("bucket").applyInPandas(packed, "bucket int, rooms binary"), "rooms")
    shared = far.where("several > 0").select(F.explode(F.array("bucket", "asker")).alias("bucket"), "room").distinct()
    return rooms, materialize(shared, "asks")


def _each(seated: bytes) -> np.ndarray:
    """Tables of the dishes with several customers, large dishes first."""
    return np.concatenate([x.astype(np.int64) for x in unpack(seated)])


def _add_up(frame: DataFrame, width: int) -> np.ndarray:
    """Sum of the packed vectors in ``totals``: added within a task, then by place."""

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(width)
        for b in batches:
            for blob in b["totals"]:
                at, v = unpack(blob)
                total[at] += v
        at = np.flatnonzero(total)
        yield pd.DataFrame({"at": at, "v": total[at]})

    rows = frame.select("totals").mapInPandas(add, "at long, v double").groupBy("at").agg(F.sum("v").alias("v")).toPandas()
    out = np.zeros(width)
    out[rows["at"].to_numpy(np.int64)] = rows["v"].to_numpy(np.float64)
    return out


def _sparse(v: np.ndarray) -> bytes:
    at = np.flatnonzero(v)
    return pack(at, v[at])


@contextmanager
def _cleaned(spark: SparkSession) -> Iterator[None]:
    """Tables written meanwhile leave no shuffle files behind: every sweep shuffles all customers."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)


def fit(
    train: DataFrame, words: Dictionary, burn: int = BURN, kept: int = KEPT, per_bucket: int = 2_000_000
) -> tuple[Model, DataFrame, DataFrame, list[tuple[DataFrame, DataFrame]], int]:
    """Model, customers by bucket, rare restaurants by bucket, seated tables and answers by bucket for each kept sweep, and
    the number of buckets."""
    spark = train.sparkSession
    sc = spark.sparkContext
    buckets = max(40, -(-words.total // per_bucket))
    held = sc.broadcast(words)

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in chunks(batches):
            w, place, context, doc = held.value.coded(list(part["text"]))
            rows = list(_deal(place, w, context, np.zeros(len(doc), np.int64), buckets, {}, 0))
            yield pd.DataFrame({"bucket": [r[0] for r in rows], "data": [r[2] for r in rows]})
        give_back()

    def merge(rows: pd.DataFrame) -> pd.DataFrame:
        blob = _merge(rows["data"])
        t = Types(blob)
        near = t.context < CONTEXTS
        counts = np.concatenate((
            np.bincount(t.context[near], t.customers[near], minlength=CONTEXTS), np.bincount(t.context[near], minlength=CONTEXTS),
            [(t.customers == 1).sum(), (t.customers == 2).sum(), len(t.customers)],
        ))
        give_back()
        return pd.DataFrame({
            "bucket": rows["bucket"].iloc[:1], "types": [blob], "rows": [int(t.customers.sum())], "totals": [_sparse(counts)], "far": [pack(*t.far())],
        })

    # Every bucket is there: restaurants may be dealt to one that has no pairs of its own.
    every = spark.range(buckets).select(F.col("id").cast("int").alias("bucket"), F.lit(pack(*_nothing())).alias("data"))
    dealt = train.select("text").mapInPandas(deal, "bucket int, data binary").unionByName(every)
    types = materialize(dealt.groupBy("bucket").applyInPandas(merge, "bucket int, types binary, rows long, totals binary, far binary"), "types")
    rooms, asks = _rare_rooms(types, buckets)
    counts = _add_up(types, 2 * CONTEXTS + 3)
    model = Model(words)
    model.customers = counts[:CONTEXTS]
    once, twice, distinct = counts[-3:]
    model.discount = float(np.clip(once / max(once + 2 * twice, 1), 0.1, 0.95))
    # Before the first seating restaurants have one table a dish, rare ones as far as a bucket knows them.
    start = Model(words)
    start.__dict__ |= model.__dict__
    start.tables, start.seats, start.opening = [counts[CONTEXTS:-3]], [float(distinct)], [1 + 0.75 * words.types]
    start.parent = [(words.counts + 1.0) / (words.total + words.types + 1)]
    current, samples = start, []
    base = types.select("bucket", "types").join(rooms, "bucket", "left")

    seating: DataFrame | None = None
    run = uuid.uuid4().int & 0xFFFFFFFF
    for sweep in range(burn + kept):
        now = sc.broadcast(current)
        if seating is None:
            source = base.withColumns({"seated": F.lit(None).cast("binary"), "answer": F.lit(None).cast("binary")})
        else:
            source = base.join(seating.select("bucket", "seated"), "bucket").join(answers, "bucket", "left")
        sample = max(0, sweep - burn)

        def move(batches: Iterator[pd.DataFrame], now=now, sweep=sweep, sample=sample) -> Iterator[pd.DataFrame]:
            model = now.value
            for b in batches:
                for bucket, blob, room, seated, answer in zip(b["bucket"], b["types"], b["rooms"], b["seated"], b["answer"], strict=True):
                    t, rooms = Types(blob), Rooms(room)
                    customers, rng = t.customers[t.many], np.random.default_rng([int(bucket), sweep])
                    tables = t.tables(_each(seated)) if _given(seated) else np.minimum(t.customers, 1)
                    rare = t.rooms(t.rare, rooms, tables, _answer(answer)) if _given(seated) else np.bincount(t.context, minlength=CONTEXTS + len(t.rare))[CONTEXTS:]
                    chance = t.chance(model, 0, tables)[0][t.many]
                    held = np.concatenate((model.tables[0], rare))[t.context[t.many]]
                    others = np.maximum(held - tables[t.many], 0)
                    each = draw_tables(customers, (model.strength + model.discount * others) * chance, model.discount * chance, model.discount, rng.random(len(customers)))
                    tables = t.tables(each)
                    large = int((customers > WHOLE).sum())
                    yield pd.DataFrame({
                        "bucket": [bucket],
                        "seated": [pack(each[:large].astype(np.int64), each[large:].astype(np.uint16))],
                        "totals": [_sparse(t.totals(model, tables, sample))],
                        "mail": [t.mail(rooms, tables)],
                    })
        give_back()

        seating = materialize(source.mapInPandas(move, "bucket int, seated binary, totals binary, mail binary"), f"seating-{run}-{sweep}")
        totals = _add_up(seating, CONTEXTS + len(words.words) + 2)
        model.add(totals, sample)
        current = model.only(-1)
        answers = materialize(_answers(seating, asks), "answers")
        if sweep < burn:
            model.tables, model.parent, model.opening, model.seats = [], [], [], []
        else:
            samples.append((seating, answers))
    return model, types, rooms, samples, buckets


# ---- scores ------------------------------------------------------------------------------------


class Home:
    """Rare restaurants of a bucket: customers, and tables in each kept sweep."""

    def __init__(self, words: np.ndarray, customers: np.ndarray, *tables: np.ndarray):
        self.words, self.customers, self.tables = words, customers, tables

    @staticmethod
    def of(types: Types, rooms: Rooms, kept: list[np.ndarray], answers: list[tuple[np.ndarray, np.ndarray]]) -> Home:
        words = np.union1d(types.after, rooms.words)
        customers = _weighed(np.searchsorted(words, types.after), types.customers[types.late :], len(words))
        customers[np.searchsorted(words, rooms.words)] += rooms.customers
        return Home(words, customers, *[types.rooms(words, rooms, tables, answer) for tables, answer in zip(kept, answers, strict=True)])

    def packed(self) -> bytes:
        return pack(self.words, *[x.astype(np.int64) for x in (self.customers, *self.tables)])

    def chance(self, model: Model, room: np.ndarray, own: np.ndarray, parent: list[np.ndarray]) -> np.ndarray:
        """Probability of dishes from their own part of it (summed over sweeps) and the parent's; new restaurants have no customers."""
        at, there = _found(self.words, room)
        total, customers = own, np.zeros(len(room))
        customers[there] = self.customers[at[there]]
        for tables, p in zip(self.tables, parent, strict=True):
            held = np.zeros(len(room))
            held[there] = tables[at[there]]
            total = total + (model.strength + model.discount * held) * p
        return total / len(parent) / (model.strength + customers)


def predict(model: Model, types: Types, seated: list[np.ndarray], data: list[np.ndarray], home: Home | None = None):
    """(log10 probability, base log10 probability, known) of a chunk's rows of one bucket, rare rows after pairs, then rows
    of rare restaurants.

    With a home, the rare rows of rare restaurants get none (0) here; what their restaurants need comes fourth.
    """
    pairs, _, _, words, context, _, _, *more = data
    after, follow = (more[0], more[1].astype(np.int64)) if more else (np.empty(0, np.uint64), np.empty(0, np.int64))
    context = context.astype(np.uint64)
    at, hit = _found(types.pairs, pairs)
    rare_at, _ = _found(types.rare_key, _rare_key(words, context))
    rare_hit = np.zeros(len(words), bool)
    if len(types.rare_key):
        rare_at = types.rare_order[rare_at]
        rare_hit = (types.words[rare_at] == words) & (types.before[rare_at] == context)
    dish, known = _found(types.dishes, words)
    place = (pairs >> 16).astype(np.int64)
    where, found = np.concatenate((at, rare_at + len(types.pairs))).astype(np.int64), np.concatenate((hit, rare_hit))
    far = np.concatenate((np.zeros(len(pairs), bool), context >= FIRST))
    room = np.concatenate(((pairs & 0xFFFF).astype(np.int64), np.where(context < FIRST, context, 0).astype(np.int64)))
    mean, own_sum, parents = np.zeros(len(where)), np.zeros(len(where)), []
    for s, each in enumerate(seated):
        tables, rare = each
        unknown = model.opening[s] * model.base / (model.parent_strength + model.seats[s])
        parent = np.concatenate((model.parent[s][place], np.where(known, rare[dish] if len(rare) else 0.0, unknown)))
        own = np.zeros(len(where))
        own[found] = types.customers[where[found]] - model.discount * tables[where[found]]
        mean += (own + (model.strength + model.discount * model.tables[s][room]) * parent) / (model.strength + model.customers[room])
        own_sum += own
        parents.append(parent[far])
    mean /= len(seated)
    logs = np.where(far, 0.0, np.log10(mean))
    base = np.log10((np.where(known, types.dish_customers[dish] if len(types.dishes) else 0, 0) + 1.0) / (model.words.total + model.words.types + 1))
    if home is None:
        return logs, base, known
    at, there = _found(types.rare, after)
    at, hit = _found(types.late_key, at << 16 | follow)
    hit &= there
    at = at + types.late
    own = np.zeros(len(after))
    for tables, _ in seated:
        own[hit] += types.customers[at[hit]] - model.discount * tables[at[hit]]
    late = np.log10(home.chance(model, after, own, [p[follow] for p in model.parent]))
    return np.concatenate((logs, late)), base, known, (far[len(pairs) :], own_sum[far], parents)


def score(docs: DataFrame, held_out: Column, burn: int = BURN, kept: int = KEPT, per_bucket: int = 2_000_000, dictionary: int = DICTIONARY) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity) of every row.

    The model learns from the rows where ``held_out`` is false. Null and empty texts are the end
    alone. Without any row to learn from, every token is the unknown word. Repeated rows each count
    and are scored alike. An empty table gives no rows.
    """
    if dictionary > DICTIONARY:
        raise ValueError(f"the dictionary holds at most {DICTIONARY} words")
    ship()
    sc = docs.sparkSession.sparkContext
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"), F.coalesce(held_out, F.lit(False)).alias("held"))
    train = rows.where(~F.col("held"))
    with _cleaned(docs.sparkSession):
        words = learn_words(train, dictionary)
        model, types, rooms, samples, buckets = fit(train, words, burn, kept, per_bucket)
    # A bucket with more rows than others is split by chunks, and each part gets its pairs.
    splits = F.greatest(F.ceil(F.col("rows") / (4 * per_bucket)), F.lit(1)).cast("int")
    large = {r["bucket"]: r["n"] for r in types.select("bucket", splits.alias("n")).where("n > 1").collect()}
    held, parts = sc.broadcast(model), sc.broadcast(large)

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words, split = held.value.words, parts.value
        task = TaskContext.get().partitionId()
        logs = np.log10((words.counts + 1.0) / (words.total + words.types + 1))
        for number, part in enumerate(chunks(batches)):
            chunk = task << 24 | number
            w, place, context, doc = words.coded(list(part["text"]))
            n = len(part)
            known = place >= 0
            ids = part["doc_id"]
            head = pack(
                ids.fillna(0).to_numpy(np.int64), ids.isna().to_numpy(bool), part["held"].to_numpy(bool),
                np.bincount(doc, minlength=n), np.bincount(doc[known], minlength=n), _weighed(doc[known], logs[place[known]], n),
            )
            salt = int(mix(np.array([chunk], np.uint64))[0] >> _U(8))
            out = [(-1 - salt % buckets, 0, chunk, head)]
            out += [(k, s, chunk, blob) for k, s, blob in _deal(place, w, context, doc, buckets, split, salt)]
            yield pd.DataFrame(out, columns=["bucket", "salt", "chunk", "data"])
        give_back()

    def rate(rows: pd.DataFrame) -> pd.DataFrame:
        if rows["bucket"].iloc[0] < 0:
            return rows[["bucket", "chunk", "data"]].assign(kind=HEAD)
        model = held.value
        given = dict(rows.loc[rows["chunk"] < 0, ["chunk", "data"]].itertuples(index=False))
        types, room, count = Types(given[TYPES]), Rooms(given.get(TYPES - 1)), range(len(model.tables))
        key = _rare_key(types.words, types.before)
        types.rare_order = np.argsort(key)
        types.rare_key = key[types.rare_order]
        types.dish_customers = np.bincount(types.dish, types.customers[types.rows], minlength=len(types.dishes))
        kept = [types.tables(_each(given[TYPES - 2 - 2 * s])) for s in count]
        seated = [(tables, types.rare_chance(model, s, tables)) for s, tables in enumerate(kept)]
        home = Home.of(types, room, kept, [_answer(given.get(TYPES - 3 - 2 * s)) for s in count])
        out = [] if rows["salt"].iloc[0] else [(int(rows["bucket"].iloc[0]), -1, home.packed(), ASKED)]
        passed = []
        for chunk, data in rows[rows["chunk"] >= 0][["chunk", "data"]].itertuples(index=False):
            data = unpack(data)
            logs, base, known, (far, own, parents) = predict(model, types, seated, data, home)
            doc = np.concatenate((data[1], data[5], data[9])).astype(np.int64)
            n = np.concatenate((data[2], data[6], data[10])).astype(np.int64)
            present, at = np.unique(doc, return_inverse=True)
            rare = slice(len(data[0]), len(data[0]) + len(data[3]))
            out.append((-1, chunk, pack(
                present.astype(np.uint16), _weighed(at, logs * n, len(present)), _weighed(at[rare], base * n[rare], len(present)),
                _weighed(at[rare], known * n[rare], len(present)).astype(np.uint32),
            ), PART))
            passed.append((data[4][far], np.full(int(far.sum()), chunk), data[5][far], data[6][far], own, *parents))
        # Rare words after rare words go on to their restaurants.
        if passed:
            passed = [np.concatenate(x) for x in zip(*passed, strict=True)]
            to = (passed[0] % _U(buckets)).astype(np.int64)
            out += [(int(to[at[0]]), 0, pack(*[x[at] for x in passed]), ASKED) for at in _equal(to)]
        give_back()
        return pd.DataFrame(out, columns=["bucket", "chunk", "data", "kind"])

    def visit(rows: pd.DataFrame) -> pd.DataFrame:
        """Restaurants' part in the scores of rare words after rare words."""
        home = Home(*unpack(rows.loc[rows["chunk"] < 0, "data"].iloc[0]))
        asked = [unpack(b) for b in rows.loc[rows["chunk"] >= 0, "data"]]
        if not asked:
            return pd.DataFrame({"chunk": [], "data": [], "kind": []})
        room, chunk, doc, n, own, *parents = (np.concatenate(x) for x in zip(*asked, strict=True))
        order, starts = _runs(chunk, doc)
        logs = _sums((np.log10(home.chance(held.value, room, own, parents)) * n)[order], starts)
        chunk, doc, out = chunk[order][starts], doc[order][starts], []
        for at in _equal(chunk):
            out.append((int(chunk[at[0]]), pack(doc[at], logs[at], np.zeros(len(at)), np.zeros(len(at), np.uint32)), PART))
        return pd.DataFrame(out, columns=["chunk", "data", "kind"])

    def finish(rows: pd.DataFrame) -> pd.DataFrame:
        ids, unknown, held_flag, n, known, base = unpack(rows.loc[rows["kind"] == HEAD, "data"].iloc[0])
        known, base, total = known.copy(), base.copy(), np.zeros(len(ids))
        for blob in rows.loc[rows["kind"] == PART, "data"]:
            doc, s, b, k = unpack(blob)
            total[doc] += s
            base[doc] += b
            known[doc] += k
        return pd.DataFrame({
            "doc_id": pd.Series(ids, dtype="Int64").mask(unknown), "held_out": held_flag, "n_tokens": n, "n_known": known,
            "train_tokens": held.value.words.total, "base_score": base, "score": total, "perplexity": 10.0 ** np.minimum(-total / n, 300),
        })

    dealt = rows.mapInPandas(deal, "bucket int, salt int, chunk long, data binary")
    # What a bucket needs comes to it as rows of their own, under negative numbers of chunks.
    given = [types.select("bucket", "types"), rooms.select("bucket", "rooms")]
    for seating, answers in samples:
        given += [seating.select("bucket", "seated"), answers.select("bucket", "answer")]
    parts_of = F.coalesce(F.create_map(*[F.lit(x) for pair in large.items() for x in pair])[F.col("bucket")], F.lit(1)) if large else F.lit(1)
    for k, table in enumerate(given):
        salt = F.explode(F.sequence(F.lit(0), parts_of - 1)).alias("salt")
        dealt = dealt.unionByName(table.select("bucket", salt, F.lit(TYPES - k).cast("long").alias("chunk"), F.col(table.columns[1]).alias("data")))
    with _cleaned(docs.sparkSession):
        rated = materialize(dealt.groupBy("bucket", "salt").applyInPandas(rate, "bucket int, chunk long, data binary, kind int"), "rated")
    visited = rated.where(F.col("kind") == ASKED).groupBy("bucket").applyInPandas(visit, "chunk long, data binary, kind int")
    rated = rated.where(F.col("kind") != ASKED).select("chunk", "data", "kind").unionByName(visited)
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double"
    return rated.groupBy("chunk").applyInPandas(finish, schema)


def _nothing() -> list[np.ndarray]:
    return [np.empty(0, t) for t in (np.uint32, np.uint16, np.uint32, np.uint64, np.uint64, np.uint16, np.uint32, np.uint64, np.uint16, np.uint16, np.uint32)]
