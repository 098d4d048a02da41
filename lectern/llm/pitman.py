"""A hierarchical Pitman-Yor language model, its seating sampled by Gibbs, and the scores of all texts.

A token's context is the token before it, or the start of the text. Every context has a restaurant of its own; all of
them share one parent, the restaurant of single tokens, whose base is uniform over the V distinct training tokens and
one place for all others. In every restaurant customers of a dish (token) sit at tables, and each table of a context's
restaurant sends a customer to the parent.

Seating is held as t, the number of tables of the c customers of a dish. Given a context's auxiliary variable
x ~ Gamma(strength / discount + tables of the restaurant) and the parent's probability p of the dish, t is independent
of all other dishes, with weights S(c, t) * (discount * x * p)**t, S the generalised Stirling numbers. A sweep draws x
of all contexts, t of all dishes and the parent's tables in the same way. After ``BURN`` sweeps ``SAMPLES`` seatings
are kept; probabilities are the averages of theirs, and each seating's sum to 1. Numbers of tables are drawn by
inversion up to ``EXACT`` customers; beyond, from the limit of that distribution (Poisson or normal, its mean and
variance from the saddle point of the generating function).

Every draw's random number is a hash of the words it belongs to and the sweep. So results don't depend on the number
of rows, partitions or buckets (but for the order in which floating-point numbers are added, and what each bucket adds
to a text's score is sent with 24 binary digits).

How it is spread. A word is common if it makes up 1 / ``SHARE`` of the training tokens or more; there are ``SHARE`` of
them at most, and what a sweep knows about them (x, p) is broadcast. A pair of two common words lives in a bucket by the
hash of the pair, any other pair in the bucket of its rare word, which holds that word's restaurant and its dish in
the parent. So no restaurant or dish has to fit one task, and none is hot. Sweeps read the pairs of all buckets, written
once; what couples buckets, tables by common context and customers by common dish, is summed over all of them after
every sweep. A pair of two rare words is held by both their buckets. With ``sample_rare`` they are drawn as all others
are: after every sweep the buckets tell each other x and the parent's customers and tables of the words that meet twice
or more (a pair seen once has one table), both draw the pair's tables from the same numbers with the same random one,
and x and p of rare words carry over to the next sweep. So which words are common makes no difference to the chain.
Without it a rare word's restaurant and dish are drawn anew in every sweep, by ``INNER`` rounds from the seating with
fewest tables, and a pair of two rare words sits at one table always.

Scoring deals out the tokens of all texts in the same way; each bucket gets the kept draws of its pairs. Pairs that
make up more than 1 / ``HOT`` of the training tokens don't travel: there are fewer than ``HOT``, and every task knows
their probabilities.

Words are known by 64-bit hashes.
"""

from __future__ import annotations

import base64
import contextlib
import ctypes
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import RDD, TaskContext
from pyspark.serializers import BatchedSerializer, CPickleSerializer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.text_arrays import mix64, utf8, word_hashes
from lectern.session import checkpoint_folder, checkpointed

BURN, SAMPLES, INNER = 3, 3, 2
EXACT = 256
SHARE, HOT = 1 << 18, 1 << 13
DISCOUNT, STRENGTH = 0.8, 5.0
ROOT_DISCOUNT, ROOT_STRENGTH = 0.6, 50.0
#: Training tokens for each bucket of pairs; a bucket is one task's share.
BUCKET_TOKENS = 1 << 20
#: Bytes of text, and texts, that a task turns into one block; a longer text makes one by itself.
BLOCK_BYTES, BLOCK_TEXTS = 4 << 20, 4096
#: Numbers of a vector that one row holds while buckets are summed.
_CHUNK = 1 << 13
_END, _START = np.uint64(0xE1D5A2B39F00C3D7), np.uint64(0x57A27B11E4F90A3D)
#: A pair of two rare words is known by one's hash and 40 bits of the other's.
_SHORT = np.uint64(24)
#: Kinds of records that a rare word owns: it is the context of a common or rare dish, the dish of a common or rare context.
_OF_COMMON, _IN_COMMON, _OF_RARE, _IN_RARE = range(4)
#: What a sweep sends: a part of its sums, what another bucket or the same one starts the next sweep from, kept draws.
_SUM, _FAR, _OWN, _KEPT = range(4)


# ---------------------------------------------------------------- random numbers and tables


def keyed(*parts: np.ndarray | int) -> np.ndarray:
    """One 64-bit key from several numbers."""
    out = np.uint64(0x243F6A8885A308D3)
    with np.errstate(over="ignore"):
        for p in parts:
            out = mix64(np.atleast_1d((np.asarray(p).astype(np.uint64) + out) * np.uint64(0x9E3779B97F4A7C15)))
    return out


def uniform(key: np.ndarray, salt: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return ((mix64(key + np.uint64(salt) * np.uint64(0xD1342543DE82EF95)) >> np.uint64(11)).astype(float) + 0.5) * 2.0**-53


def normal(key: np.ndarray, salt: int) -> np.ndarray:
    return np.sqrt(-2 * np.log(uniform(key, 2 * salt))) * np.cos(2 * np.pi * uniform(key, 2 * salt + 1))


def gamma(shape: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Gamma variates of shapes above 1, one for each key, by Marsaglia and Tsang's rejection."""
    out, open_, salt = np.zeros(len(shape)), np.arange(len(shape)), 100
    while len(open_):
        d = shape[open_] - 1 / 3
        n, u = normal(key[open_], salt), uniform(key[open_], 2 * salt + 2)
        v = (1 + n / np.sqrt(9 * d)) ** 3
        with np.errstate(invalid="ignore", divide="ignore"):
            good = (v > 0) & (np.log(u) < 0.5 * n * n + d - d * v + d * np.log(v))
        out[open_[good]] = (d * v)[good]
        open_, salt = open_[~good], salt + 2
    return out


def stirling(discount: float, most: int = EXACT) -> np.ndarray:
    """Logarithms of the generalised Stirling numbers S(c, t) for c, t up to ``most``."""
    out = np.full((most + 1, most + 1), -np.inf)
    out[1, 1] = 0.0
    for c in range(1, most):
        t = np.arange(1, c + 1)
        stay = out[c, 1 : c + 1] + np.log(c - t * discount)
        out[c + 1, 1 : c + 1] = stay
        out[c + 1, 1 : c + 2] = np.logaddexp(out[c + 1, 1 : c + 2], np.concatenate([[-np.inf], out[c, 1 : c + 1]]))
    return out


_TABLES = {d: stirling(d) for d in (DISCOUNT, ROOT_DISCOUNT)}


def limit(customers: np.ndarray, price: np.ndarray, discount: float) -> tuple[np.ndarray, np.ndarray]:
    """Mean and variance of the number of tables beyond the first, for many customers."""
    low, high = np.full(len(price), -700.0), np.zeros(len(price))
    want = np.log(customers / price)
    for _ in range(80):
        mid = (low + high) / 2
        above = np.log1p(-np.exp(mid)) + (discount - 1) * mid > want
        low, high = np.where(above, mid, low), np.where(above, high, mid)
    y = np.exp((low + high) / 2)
    f, f1, f2 = (1 - y**discount) / discount, y ** (discount - 1), (1 - discount) * y ** (discount - 2)
    tables = price * f
    mean, square = (1 - y) * f1 / f, (1 - y) * (f1 + (1 - y) * f2) / f
    spread = np.maximum(1 - mean * mean / square, 1e-12)
    return tables - 1 + spread, tables * spread


def draw_tables(customers: np.ndarray, price: np.ndarray, discount: float, key: np.ndarray) -> np.ndarray:
    """Numbers of tables for dishes with so many customers; price: what each table weighs besides the seating."""
    out = np.minimum(customers, 1).astype(np.int64)
    many = np.flatnonzero(customers > 1)
    if not len(many):
        return out
    price = np.maximum(price, 1e-290)
    u, table = uniform(key[many], 1), _TABLES[discount]
    order = np.argsort(customers[many], kind="stable")
    sizes, first = np.unique(customers[many][order], return_index=True)
    for c, a, b in zip(sizes, first, [*first[1:], len(order)], strict=True):
        if c > EXACT:
            break
        for lo in range(a, b, 32_768):
            at = order[lo : min(b, lo + 32_768)]
            weight = table[c, 1 : c + 1] + np.arange(1, c + 1) * np.log(price[many[at]])[:, None]
            weight = np.exp(weight - weight.max(1, keepdims=True))
            total = np.cumsum(weight, 1)
            out[many[at]] = 1 + (total < (u[at] * total[:, -1])[:, None]).sum(1)
    big = np.flatnonzero(customers[many] > EXACT)
    if len(big):
        at, n = many[big], customers[many[big]].astype(float)
        mean, var = limit(n, price[at], discount)
        t = 1 + np.rint(mean + np.sqrt(var) * normal(key[at], 5))
        few = np.flatnonzero(mean < 30)
        if len(few):
            rate, k = np.maximum(mean[few], 0), np.zeros(len(few))
            chance = np.exp(-rate)
            total = chance.copy()
            for i in range(1, 120):
                k += total < u[big[few]]
                chance = chance * rate / i
                total += chance
            t[few] = 1 + k
        out[at] = np.clip(t, 1, n).astype(np.int64)
    return out


# ---------------------------------------------------------------- the state of the chain


@dataclass
class State:
    """What a sweep starts from, about common words by their index, and the parent's totals."""

    x: np.ndarray
    p: np.ndarray
    root_x: float
    root_tables: float
    root_customers: float
    sweep: int


@dataclass
class Sample:
    """A kept sweep: where it started and what it led to."""

    start: State
    tables: np.ndarray  # by common context
    end: State  # p and the parent's totals of the seating


@dataclass
class Common:
    """Common words, the most frequent first, with their counts as tokens; the start counts as a context only."""

    words: np.ndarray
    count: np.ndarray
    followed: np.ndarray  # as contexts
    tokens: int
    vocabulary: int
    buckets: int
    homes: int  # a sweep's tasks; each has the buckets of one remainder
    slot: np.ndarray = field(init=False)
    by_hash: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        self.slot, self.by_hash = np.zeros(1 << 20, np.int32), np.argsort(self.words)
        self.slot[self.words >> np.uint64(44)] = np.arange(len(self.words))

    @property
    def base(self) -> float:
        return 1.0 / (self.vocabulary + 1)

    @property
    def bits(self) -> int:
        return max(1, int(len(self.words) - 1).bit_length())

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Indices of words, -1 for rare ones."""
        at = self.slot[hashes >> np.uint64(44)].astype(np.int64)
        miss = np.flatnonzero(self.words[at] != hashes)
        near = self.by_hash[np.minimum(np.searchsorted(self.words, hashes[miss], sorter=self.by_hash), len(self.words) - 1)]
        at[miss] = np.where(self.words[near] == hashes[miss], near, -1)
        return at

    def smoothed(self, count: np.ndarray) -> np.ndarray:
        """The base's log10 probabilities of tokens seen so often."""
        return np.log10((count + 0.1) / (self.tokens + 0.1 * (self.vocabulary + 1)))

    def parent(self, customers: np.ndarray, tables: np.ndarray, state: State) -> np.ndarray:
        """The parent's probabilities of dishes."""
        spare = ROOT_STRENGTH + ROOT_DISCOUNT * state.root_tables
        return (customers - ROOT_DISCOUNT * tables + spare * self.base) / (ROOT_STRENGTH + state.root_customers)

    def first(self) -> State:
        customers = np.maximum(self.count, 0) ** DISCOUNT
        p = (self.count + 0.1) / (self.tokens + 0.1 * (self.vocabulary + 1))
        return State(STRENGTH / DISCOUNT + self.followed**DISCOUNT, p, ROOT_STRENGTH / ROOT_DISCOUNT + self.vocabulary, self.vocabulary, customers.sum() + max(0, self.vocabulary - len(self.words)), 0)

    def next(self, start: State, tables: np.ndarray, customers: np.ndarray, rare_tables: int, rare_customers: int) -> tuple[Sample, State]:
        """The sweep's sample and the next one's start, from sums over all buckets."""
        dishes = np.full(len(customers), ROOT_DISCOUNT * start.root_x * self.base)
        own = draw_tables(customers, dishes, ROOT_DISCOUNT, keyed(self.words, 11, start.sweep))
        total = float(own.sum() + rare_tables)
        end = State(
            gamma(STRENGTH / DISCOUNT + tables, keyed(self.words, 12, start.sweep)), np.zeros(0),
            float(gamma(np.array([ROOT_STRENGTH / ROOT_DISCOUNT + total]), keyed(13, start.sweep))[0]), total, float(customers.sum() + rare_customers), start.sweep + 1,
        )
        end.p = self.parent(customers, own, end)
        return Sample(start, tables, end), end


def _starts(n: np.ndarray) -> np.ndarray:
    return np.cumsum(n) - n


@dataclass
class Pairs:
    """Training pairs of a bucket: pairs of two common words; of rare words (owners) the records of all kinds."""

    v: np.ndarray
    w: np.ndarray
    c: np.ndarray
    owners: np.ndarray  # sorted hashes
    owner: np.ndarray
    kind: np.ndarray
    other: np.ndarray  # index of a common word, hash of a rare one
    n: np.ndarray

    def of(self, kind: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at = np.flatnonzero(self.kind == kind)
        return self.owner[at], self.other[at].astype(np.int64) if kind in (_OF_COMMON, _IN_COMMON) else self.other[at], self.n[at]

    def by_owner(self, owner: np.ndarray, x: np.ndarray | None = None) -> np.ndarray:
        return np.bincount(owner, x, len(self.owners)).astype(np.int64)

    def sweep(self, common: Common, state: State) -> Drawn:
        """One sweep's draws; those of rare words start from as few tables as there are pairs."""
        words, r = common.words, state.sweep
        t = draw_tables(self.c, DISCOUNT * state.x[self.v] * state.p[self.w], DISCOUNT, keyed(words[self.v], words[self.w], r))
        both = [np.ones(len(self.of(kind)[0]), np.int64) for kind in (_OF_RARE, _IN_RARE)]
        # restaurants of rare contexts
        owner, dish, n = self.of(_OF_COMMON)
        fixed = self.by_owner(self.of(_OF_RARE)[0])
        served, own = np.ones(len(n), np.int64), self.by_owner(owner) + fixed
        for j in range(INNER):
            x = gamma(STRENGTH / DISCOUNT + own, keyed(self.owners, 21, r, j))
            served = draw_tables(n, DISCOUNT * x[owner] * state.p[dish], DISCOUNT, keyed(self.owners[owner], words[dish], r, j))
            own = self.by_owner(owner, served) + fixed
        # rare dishes
        owner2, context, n2 = self.of(_IN_COMMON)
        fixed = self.by_owner(self.of(_IN_RARE)[0])
        seated, customers = np.ones(len(n2), np.int64), self.by_owner(owner2) + fixed
        tables = np.minimum(customers, 1)
        for j in range(INNER):
            p = common.parent(customers, tables, state)
            seated = draw_tables(n2, DISCOUNT * state.x[context] * p[owner2], DISCOUNT, keyed(words[context], self.owners[owner2], r, j))
            customers = self.by_owner(owner2, seated) + fixed
            tables = draw_tables(customers, np.full(len(customers), ROOT_DISCOUNT * state.root_x * common.base), ROOT_DISCOUNT, keyed(self.owners, 22, r, j))
        return Drawn(t, [served, seated, *both], own, customers, tables)

    def meetings(self, kind: int, buckets: int) -> Meetings:
        """The pairs of two rare words seen twice or more, in an order that both buckets know."""
        owner, other, n = self.of(kind)
        short = self.owners >> _SHORT
        same, clash = short[1:] == short[:-1], np.zeros(len(short), bool)
        clash[:-1] = same
        clash[1:] |= same
        rows = np.flatnonzero((n > 1) | clash[owner])
        near, far = short[owner[rows]], other[rows]
        peer = _bucket(far, buckets)
        left, right = (near, far) if kind == _OF_RARE else (far, near)
        order = np.lexsort((-n[rows], right, left, peer))
        rows, left, right, peer = rows[order], left[order], right[order], peer[order]
        begin = _runs(left, right)
        sizes = _lengths(begin, len(rows))
        twice = np.add.reduceat(n[rows], begin) > 1 if len(begin) else np.zeros(0, bool)
        held = np.repeat(twice, sizes)
        first = begin[twice]
        group = np.repeat(np.arange(len(first)), sizes[twice])
        return Meetings(rows[held], group, left[held], right[held], owner[rows[first]], peer[first])

    def wanted(self, kind: int, met: Meetings) -> np.ndarray:
        """Owners whose x (of contexts) or p (of dishes; kind: of common) draws depend on."""
        out = np.zeros(len(self.owners), bool)
        owner, _, n = self.of(kind)
        out[owner[n > 1]] = True
        owner, _, n = self.of(kind + 2)
        out[owner[n > 1]] = True
        out[met.owner] = True
        return np.flatnonzero(out)

    def first(self, common: Common) -> tuple[np.ndarray, np.ndarray]:
        """By owner, where the first sweep starts: x and p, as ``Common.first`` has them."""
        followed, count = (sum(self.by_owner(self.of(k)[0], self.of(k)[2]) for k in kinds) for kinds in ((_OF_COMMON, _OF_RARE), (_IN_COMMON, _IN_RARE)))
        return STRENGTH / DISCOUNT + followed**DISCOUNT, (count + 0.1) / (common.tokens + 0.1 * (common.vocabulary + 1))

    def chained(self, common: Common, state: State, met: list[Meetings], own: list[np.ndarray], far: list[np.ndarray]) -> Drawn:
        """One sweep's draws where the chain goes on for rare words too; own, far: x of contexts and what p of dishes follows from, by owner and by meeting."""
        words, r = common.words, state.sweep
        known = (lambda at: at) if r == 0 else (lambda at: common.parent(at, 0, state))
        t = draw_tables(self.c, DISCOUNT * state.x[self.v] * state.p[self.w], DISCOUNT, keyed(words[self.v], words[self.w], r))
        x, p = own[0], known(own[1])
        owner, dish, n = self.of(_OF_COMMON)
        served = draw_tables(n, DISCOUNT * x[owner] * state.p[dish], DISCOUNT, keyed(self.owners[owner], words[dish], r))
        owner2, context, n2 = self.of(_IN_COMMON)
        seated = draw_tables(n2, DISCOUNT * state.x[context] * p[owner2], DISCOUNT, keyed(words[context], self.owners[owner2], r))
        both = []
        for kind, m, mx, mp in ((_OF_RARE, met[0], x[met[0].owner], known(far[1])), (_IN_RARE, met[1], far[0], p[met[1].owner])):
            n = self.of(kind)[2]
            at = np.ones(len(n), np.int64)
            at[m.rows] = draw_tables(n[m.rows], (DISCOUNT * mx * mp)[m.group], DISCOUNT, keyed(m.left, m.right, r))
            both.append(at)
        out = self.drawn(t, [served, seated, *both])
        out.tables = draw_tables(out.customers, np.full(len(out.customers), ROOT_DISCOUNT * state.root_x * common.base), ROOT_DISCOUNT, keyed(self.owners, 11, r))
        return out

    def drawn(self, t: np.ndarray, records: list[np.ndarray], tables: np.ndarray | None = None) -> Drawn:
        """Draws with the totals that follow from them."""
        own, customers = (sum(self.by_owner(self.of(k)[0], records[k]) for k in kinds) for kinds in ((_OF_COMMON, _OF_RARE), (_IN_COMMON, _IN_RARE)))
        return Drawn(t, records, own, customers, tables)

    def sums(self, common: Common, d: Drawn) -> np.ndarray:
        """Tables by common context, customers by common dish, the rare dishes' tables and customers in the parent."""
        n = len(common.words)
        contexts = np.bincount(self.v, d.t, n) + np.bincount(self.of(_IN_COMMON)[1], d.records[_IN_COMMON], n)
        dishes = np.bincount(self.w, d.t, n) + np.bincount(self.of(_OF_COMMON)[1], d.records[_OF_COMMON], n)
        return np.concatenate([contexts, dishes, [d.tables.sum(), d.customers.sum()]])

    def keep(self, d: Drawn, most: int) -> bytes:
        """What chance decided in a sweep: tables of pairs seen more than once, and those of rare dishes in the parent.

        Not of pairs of common words seen more often than ``most``: these are hot and don't travel.
        """
        some = [(self.c > 1) & (self.c <= most), *(n > 1 for n in self.counts()[1:])]
        return _pack(*(_narrow(x[at]) for x, at in zip([d.t, *d.records], some, strict=True)), _narrow(d.tables))

    def kept(self, data: bytes | None) -> Drawn:
        """A sweep's draws again; None: there were no pairs. Owners without a pair have no tables."""
        got = _unpack(data, *[np.uint32] * 6) if data else [np.zeros(0, np.uint32)] * 6
        made = [np.ones(len(n), np.int64) for n in self.counts()]
        for x, n, y in zip(made, self.counts(), got, strict=False):
            x[n > 1] = y
        tables = np.zeros(len(self.owners), np.int64)
        tables[np.unique(self.owner)] = got[5]
        return self.drawn(made[0], made[1:], tables)

    def counts(self) -> list[np.ndarray]:
        return [self.c, *(self.of(kind)[2] for kind in range(4))]


@dataclass
class Meetings:
    """Records of one kind in groups; a group is a pair of two rare words, each known by 40 bits."""

    rows: np.ndarray  # among the records of the kind
    group: np.ndarray
    left: np.ndarray  # 40 bits of the context
    right: np.ndarray  # of the dish
    owner: np.ndarray  # of each group
    peer: np.ndarray  # of each group, rising: the bucket of its other word


@dataclass
class Drawn:
    """Tables of a bucket's pairs in one sweep, and the totals of rare contexts and rare dishes."""

    t: np.ndarray
    records: list[np.ndarray]  # by kind
    own: np.ndarray
    customers: np.ndarray
    tables: np.ndarray


# ---------------------------------------------------------------- blocks of tokens


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays byte by byte, all first bytes first, compressed."""
    planes = [a.tobytes() if a.itemsize == 1 else np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.itemsize).T).tobytes() for a in map(np.ascontiguousarray, arrays)]
    head = struct.pack(f"<{len(arrays)}Q", *map(len, planes))
    return zstandard.ZstdCompressor(level=1).compress(head + b"".join(planes))


def _unpack(data: bytes, *kinds: type) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(data)
    sizes = struct.unpack_from(f"<{len(kinds)}Q", raw)
    at, out = 8 * len(kinds), []
    for n, kind in zip(sizes, kinds, strict=True):
        size = np.dtype(kind).itemsize
        planes = np.frombuffer(raw, np.uint8, n, at)
        out.append(planes.view(kind) if size == 1 else np.ascontiguousarray(planes.reshape(size, n // size).T).view(kind).reshape(-1))
        at += n
    return out


def _lean(run):
    """``run``, whose freed memory goes back to the system when it ends: an idle Python worker holds none beside those at work."""

    def lean(batches):
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # a libc without it
            ctypes.CDLL(None).malloc_trim(0)

    return lean


def _narrow(x: np.ndarray) -> np.ndarray:
    """Counts of 32 bits; there are no larger ones in a block of texts."""
    return x.astype(np.uint32)


def _gaps(rising: np.ndarray) -> np.ndarray:
    """Rising numbers as the first and the steps from each to the next."""
    return _narrow(np.diff(rising, prepend=0))


def _tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all tokens of some texts, of the tokens before them, and each text's number of tokens."""
    n = len(offsets) - 1
    parts, counts = [], np.zeros(n, np.int64)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + (1 << 20), "right")) - 1)
        hashes, where = word_hashes(data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at])
        counts[at:to] = np.diff(where) + 1
        parts.append(np.insert(hashes, where[1:], _END))
        at = to
    token = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
    before = np.empty_like(token)
    before[1:] = token[:-1]
    before[_starts(counts)] = _START
    return token, before, counts


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Batches cut into ranges of rows that make up a block: rows, their texts' bytes and offsets."""
    for f in batches:
        data, offsets = utf8(f.column("text"))
        at, n = 0, f.num_rows
        while at < n:
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + BLOCK_BYTES, "right")) - 1)
            to = min(to, n, at + BLOCK_TEXTS)
            yield f.slice(at, to - at), data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
            at = to


def _sorted(*columns: tuple[np.ndarray, int]) -> list[np.ndarray]:
    """Rows of (column, bits of its values), sorted by all columns."""
    if not len(columns[0][0]):
        return [c for c, _ in columns]
    if sum(b for _, b in columns) > 64:
        order = np.lexsort([c for c, _ in reversed(columns)])
        return [c[order] for c, _ in columns]
    key = np.zeros(len(columns[0][0]), np.uint64)
    for c, bits in columns:
        key = (key << np.uint64(bits)) | c.astype(np.uint64)
    key.sort()
    out = []
    for _, bits in reversed(columns):
        out.append((key & np.uint64((1 << bits) - 1)).astype(np.int64))
        key = key >> np.uint64(bits)
    return out[::-1]


def _lengths(begin: np.ndarray, n: int) -> np.ndarray:
    """Of runs that begin at these rows of n."""
    return np.diff(np.append(begin, n))


def _runs(*columns: np.ndarray) -> np.ndarray:
    """Where rows begin that differ from the one before."""
    n = len(columns[0])
    edge = np.ones(n, bool)
    if n:
        edge[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return np.flatnonzero(edge)


def _bucket(key: np.ndarray, buckets: int) -> np.ndarray:
    return (mix64(key ^ np.uint64(0x5851F42D4C957F2D)) % np.uint64(buckets)).astype(np.int64)


def _owner_bucket(owner: np.ndarray, buckets: int) -> np.ndarray:
    """Of rare words; 40 bits tell, as much as is known of the other word of a pair."""
    return _bucket(owner >> _SHORT, buckets)


def _pair_bucket(v: np.ndarray, w: np.ndarray, buckets: int) -> np.ndarray:
    return _bucket((v.astype(np.uint64) << np.uint64(32)) | w.astype(np.uint64), buckets)


def _owned(v: np.ndarray, w: np.ndarray, before: np.ndarray, token: np.ndarray) -> list[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(kind, rows, owners, others) for tokens that have a rare word in their pair."""
    of, in_, both = np.flatnonzero((v < 0) & (w >= 0)), np.flatnonzero((v >= 0) & (w < 0)), np.flatnonzero((v < 0) & (w < 0))
    return [
        (_OF_COMMON, of, before[of], w[of].astype(np.uint64)), (_IN_COMMON, in_, token[in_], v[in_].astype(np.uint64)),
        (_OF_RARE, both, before[both], token[both] >> _SHORT), (_IN_RARE, both, token[both], before[both] >> _SHORT),
    ]


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A block's distinct tokens with their counts."""
    for _, data, offsets in _blocks(batches):
        words, n = np.unique(_tokens(data, offsets)[0], return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(n)], ["word", "n"])


def _dealt_pairs(shared):
    """(bucket, data): a block's training pairs with their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common: Common = shared.value
        buckets, width = common.buckets, common.bits
        for _, data, offsets in _blocks(batches):
            token, before, _ = _tokens(data, offsets)
            v, w = common.find(before), common.find(token)
            at = np.flatnonzero((v >= 0) & (w >= 0))
            where, left, right = _sorted((_pair_bucket(v[at], w[at], buckets), int(buckets).bit_length()), (v[at], width), (w[at], width))
            first = _runs(where, left, right)
            n, where, left, right = _lengths(first, len(where)), where[first], left[first], right[first]
            records = _owned(v, w, before, token)
            owner, other = np.concatenate([r[2] for r in records]), np.concatenate([r[3] for r in records])
            kind = np.concatenate([np.full(len(r[1]), r[0], np.uint8) for r in records])
            place = _owner_bucket(owner, buckets)
            order = np.lexsort((other, kind, owner, place))
            owner, other, kind, place = owner[order], other[order], kind[order], place[order]
            begin = _runs(owner, kind, other)
            m, owner, other, kind, place = _lengths(begin, len(owner)), owner[begin], other[begin], kind[begin], place[begin]
            edge, edge2 = (np.searchsorted(x, np.arange(buckets + 1)) for x in (where, place))
            made = []
            for b in np.flatnonzero(np.diff(edge) + np.diff(edge2)):
                s, z = slice(edge[b], edge[b + 1]), slice(edge2[b], edge2[b + 1])
                made.append((int(b), _pack(_narrow(left[s]), _narrow(right[s]), _narrow(n[s]), owner[z], kind[z], other[z], _narrow(m[z]))))
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in made], pa.int32()), pa.array([x[1] for x in made], pa.binary())], ["bucket", "data"])

    return run


_PAIRS = (np.uint32, np.uint32, np.uint32, np.uint64, np.uint8, np.uint64, np.uint32)


def _gather(parts: list[list[np.ndarray]], width: int) -> tuple[Pairs, list[np.ndarray], list[np.ndarray]]:
    """Pairs of many pieces with summed counts, and for each piece where its rows are among them."""
    lengths = [[len(p[0]) for p in parts], [len(p[3]) for p in parts]]
    v, w, c, owner, kind, other, n = (np.concatenate([p[i] for p in parts]) for i in range(7))
    key, back = np.unique((v.astype(np.uint64) << np.uint64(32)) | w, return_inverse=True)
    count = np.bincount(back, c, len(key)).astype(np.int64)
    owners, mine = np.unique(owner, return_inverse=True)
    order = np.lexsort((other, kind, mine))
    begin = _runs(mine[order], kind[order], other[order])
    run = np.repeat(np.arange(len(begin)), _lengths(begin, len(order)))
    back2 = np.empty(len(order), np.int64)
    back2[order] = run
    at = order[begin]
    pairs = Pairs((key >> np.uint64(32)).astype(np.int64), (key & np.uint64(0xFFFFFFFF)).astype(np.int64), count, owners, mine[at], kind[at], other[at], np.bincount(run, n[order], len(begin)).astype(np.int64))
    cut = lambda x, sizes: np.split(x, np.cumsum(sizes)[:-1])
    return pairs, cut(back, lengths[0]), cut(back2, lengths[1])


def _trained(p: Pairs) -> Pairs:
    """The pairs that occur in training; owners stay."""
    a, b = p.c > 0, p.n > 0
    return Pairs(p.v[a], p.w[a], p.c[a], p.owners, p.owner[b], p.kind[b], p.other[b], p.n[b])


def _merged(shared):
    """(bucket, v, w, n, data): a bucket's training pairs in one row, and a row for each hot pair; data as text, which is cheaper on its way from the JVM to Python."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common: Common = shared.value
        parts: dict[int, list[bytes]] = {}
        for f in batches:
            for bucket, data in zip(f.column("bucket").to_pylist(), f.column("data").to_pylist(), strict=True):
                parts.setdefault(bucket, []).append(data)
        for bucket in list(parts):
            p, _, _ = _gather([_unpack(x, *_PAIRS) for x in parts.pop(bucket)], common.bits)
            hot = np.flatnonzero(p.c * HOT > common.tokens)
            data = base64.b64encode(_pack(p.v, p.w, p.c, p.owners, p.owner, p.kind, p.other, p.n)).decode()
            columns = [pa.array([*x[hot].tolist(), None], pa.int64()) for x in (p.v, p.w, p.c)]
            where = pa.array([bucket] * (len(hot) + 1), pa.int32())
            yield pa.RecordBatch.from_arrays([where, *columns, pa.array([*[None] * len(hot), data], pa.string())], ["bucket", "v", "w", "n", "data"])

    return run


def _held(rows):
    """One element: training pairs by bucket, and hot ones."""
    held, hot = {}, []
    for bucket, v, w, n, text in rows:
        if text is None:
            hot.append((v, w, n))
        else:
            held[bucket] = base64.b64decode(text)
    return [(held, hot)]


def _loaded(data: bytes) -> Pairs:
    return Pairs(*_unpack(data, np.int64, np.int64, np.int64, np.uint64, np.int64, np.uint8, np.uint64, np.int64))


def _told(bucket: int, homes: int, met: list[Meetings], wanted: list[np.ndarray], own: list[np.ndarray]):
    """What this bucket and others need to go on: x of contexts and what p of dishes follows from, in 32 bits."""
    yield bucket % homes, (_OWN, bucket, bucket, _join(*(x[at] for x, at in zip(own, wanted, strict=True))))
    for peer in np.union1d(met[0].peer, met[1].peer).tolist():
        yield peer % homes, (_FAR, peer, bucket, _join(*(x[m.owner[slice(*np.searchsorted(m.peer, [peer, peer + 1]))]] for x, m in zip(own, met, strict=True))))


def _join(x: np.ndarray, y: np.ndarray) -> bytes:
    return struct.pack("<I", len(x)) + x.astype("<f4").tobytes() + y.astype("<f4").tobytes()


def _parted(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    n, both = struct.unpack_from("<I", data)[0], np.frombuffer(data, "<f4", offset=4).astype(float)
    return both[:n], both[n:]


def _heard(came: list, met: list[Meetings], wanted: list[np.ndarray], owners: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """By owner, and by meeting from the other words' buckets: x of contexts and what p of dishes follows from."""
    own = [np.zeros(owners), np.zeros(owners)]
    for x, at, y in zip(own, wanted, next(_parted(data) for tag, _, data in came if tag == _OWN), strict=True):
        x[at] = y
    parts = [_parted(data) for _, data in sorted((key, data) for tag, key, data in came if tag == _FAR)]
    far = [np.concatenate([np.zeros(0), *(x[i] for x in parts)]) for i in (0, 1)]
    assert (len(far[0]), len(far[1])) == (len(met[1].owner), len(met[0].owner))
    return own, far


def _started(shared):
    """The messages that the first sweep starts from."""

    def run(rows):
        common: Common = shared.value
        for held, _ in rows:
            for bucket, data in held.items():
                pairs = _loaded(data)
                met = [pairs.meetings(kind, common.buckets) for kind in (_OF_RARE, _IN_RARE)]
                wanted = [pairs.wanted(*x) for x in zip((_OF_COMMON, _IN_COMMON), met, strict=True)]
                yield from _told(bucket, common.homes, met, wanted, pairs.first(common))

    return run


def _swept(shared, state, sample_rare: bool, kept: int | None, last: bool):
    """(task, (tag, bucket or chunk, source or sample, data)): sums of one sweep, all kept draws so far, and what the next sweep starts from."""

    def run(rows):
        common, start = shared.value, state.value
        for (held, _), messages in rows:
            came: dict[int, list] = {}
            for tag, bucket, key, data in messages:
                came.setdefault(bucket, []).append((tag, key, data))
            sums = np.zeros(2 * len(common.words) + 2, np.int64)
            for bucket, packed in held.items():
                pairs, mine, home = _loaded(packed), came.get(bucket, []), bucket % common.homes
                if sample_rare:
                    met = [pairs.meetings(kind, common.buckets) for kind in (_OF_RARE, _IN_RARE)]
                    wanted = [pairs.wanted(*x) for x in zip((_OF_COMMON, _IN_COMMON), met, strict=True)]
                    drawn = pairs.chained(common, start, met, *_heard(mine, met, wanted, len(pairs.owners)))
                else:
                    drawn = pairs.sweep(common, start)
                sums += pairs.sums(common, drawn).astype(np.int64)
                for tag, key, data in mine:
                    if tag == _KEPT:
                        yield home, (tag, bucket, key, data)
                if kept is not None:
                    yield home, (_KEPT, bucket, kept, pairs.keep(drawn, common.tokens // HOT))
                if sample_rare and not last:
                    x = np.zeros(len(pairs.owners))
                    x[wanted[0]] = gamma(STRENGTH / DISCOUNT + drawn.own[wanted[0]], keyed(pairs.owners[wanted[0]], 12, start.sweep))
                    yield from _told(bucket, common.homes, met, wanted, [x, drawn.customers - ROOT_DISCOUNT * drawn.tables])
            if held:
                for i, k in enumerate(range(0, len(sums), _CHUNK)):
                    yield common.homes + i, (_SUM, i, 0, _pack(sums[k : k + _CHUNK]))

    return run


def _added(messages):
    """(chunk, sums of all buckets)."""
    total: dict[int, np.ndarray] = {}
    for tag, i, _, data in messages:
        if tag == _SUM:
            x = _unpack(data, np.int64)[0]
            total[i] = total[i] + x if i in total else x
    return [(i, x.tobytes()) for i, x in total.items()]


def _at_once(messages):
    """A task's messages as one element."""
    return [[m for m in messages if m[0] != _SUM]]


def _draws(messages):
    """(bucket, part, kind, data), beside the pieces of texts: part is the sample's number."""
    return [(bucket, key, 2, data) for tag, bucket, key, data in messages if tag == _KEPT]


# ---------------------------------------------------------------- scoring


@dataclass
class Model:
    """Everything that scoring tasks share: bounded by SHARE, HOT and SAMPLES."""

    common: Common
    samples: list[Sample]
    hot: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    hot_score: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def spare(self, s: Sample) -> np.ndarray:
        """By common context, what goes to the parent."""
        return (STRENGTH + DISCOUNT * s.tables) / (STRENGTH + self.common.followed)

    def pairs(self, v: np.ndarray, w: np.ndarray, c: np.ndarray, tables: list[np.ndarray]) -> np.ndarray:
        """Probabilities of pairs of common words; tables for each sample, 0 without customers."""
        p = np.zeros(len(v))
        for s, t in zip(self.samples, tables, strict=True):
            p += (c - DISCOUNT * t) / (STRENGTH + self.common.followed[v]) + self.spare(s)[v] * s.end.p[w]
        return p / len(self.samples)


def _spread(c: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Tables of trained pairs among all pairs."""
    out = np.zeros(len(c), np.int64)
    out[c > 0] = t
    return out


def _dealt_texts(shared):
    """(bucket, part, kind, data): kind 0: a block's tokens; 1: what is known of the block's texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = shared.value
        common = model.common
        buckets, width = common.buckets, common.bits
        smoothed = common.smoothed(common.count)
        task, block_no = TaskContext.get().partitionId(), 0
        for f, data, offsets in _blocks(batches):
            token, before, counts = _tokens(data, offsets)
            n, part = f.num_rows, (task << 32) | block_no
            block_no += 1
            text = np.repeat(np.arange(n), counts)
            v, w = common.find(before), common.find(token)
            seen = np.flatnonzero(w >= 0)
            known, base = np.bincount(text[seen], minlength=n), np.bincount(text[seen], smoothed[w[seen]], n).astype(float).astype(float)
            score = np.zeros(n)
            at = np.flatnonzero((v >= 0) & (w >= 0))
            if len(model.hot):
                key = (v[at].astype(np.uint64) << np.uint64(32)) | w[at].astype(np.uint64)
                place = np.minimum(np.searchsorted(model.hot, key), len(model.hot) - 1)
                is_hot = model.hot[place] == key
                score = score + np.bincount(text[at[is_hot]], model.hot_score[place[is_hot]], n)
                at = at[~is_hot]
            where, left, right, who = _sorted((_pair_bucket(v[at], w[at], buckets), int(buckets).bit_length()), (v[at], width), (w[at], width), (text[at], max(1, int(n - 1).bit_length())))
            first = _runs(where, left, right, who)
            times, where, left, right, who = _lengths(first, len(where)), where[first], left[first], right[first], who[first]
            pair = _runs(where, left, right)
            each, pair_at = _lengths(pair, len(where)), where[pair]

            records = _owned(v, w, before, token)
            rows = np.concatenate([r[1] for r in records])
            owner, other = np.concatenate([r[2] for r in records]), np.concatenate([r[3] for r in records])
            kind = np.concatenate([np.full(len(r[1]), r[0], np.uint8) for r in records])
            # tokens of two rare words come back one by one: their number among those of the block
            number = np.concatenate([*[np.zeros(len(r[1]), np.int64) for r in records[:2]], *[np.arange(len(r[1])) for r in records[2:]]])
            place = _owner_bucket(owner, buckets)
            order = np.lexsort((text[rows], other, kind, owner, place))
            owner, other, kind, place, number, of_text = owner[order], other[order], kind[order], place[order], number[order], text[rows][order]
            own = _runs(owner, kind, other)
            own_each, own_at = _lengths(own, len(owner)), place[own]

            learns = np.packbits(f.column("learns").to_numpy(zero_copy_only=False).astype(bool))
            pair_edge, edge, own_edge, rare_edge = (np.searchsorted(x, np.arange(buckets + 1)) for x in (pair_at, where, own_at, place))
            made = []
            for b in np.flatnonzero(np.diff(edge) + np.diff(rare_edge)):
                p, s, o, z = (slice(e[b], e[b + 1]) for e in (pair_edge, edge, own_edge, rare_edge))
                made.append((int(b), part, 0, _pack(
                    _narrow(left[pair][p]), _narrow(right[pair][p]), _narrow(each[p]), owner[own][o], kind[own][o], other[own][o], _narrow(own_each[o]),
                    _narrow(who[s]), _narrow(times[s]), _narrow(of_text[z]), _narrow(number[z]), learns,
                )))
            ids = f.column("doc_id")
            there = np.array([x is not None for x in ids.to_pylist()], np.uint8)
            held = f.column("held").to_numpy(zero_copy_only=False).astype(np.uint8)
            texts = _pack(np.asarray(ids.fill_null(0), np.int64), there, held, counts, known.astype(np.int64), base, score, _narrow(text[records[2][1]]))
            made.append((part % buckets, part, 1, texts))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*made, strict=True), (pa.int32(), pa.int64(), pa.int32(), pa.binary()), strict=True)], ["bucket", "part", "kind", "data"])

    return run


def _rows(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.binary()), strict=True)], ["part", "kind", "data"])


def _scored(shared):
    """(part, kind, data): each block's sums over this bucket's tokens (0), halves of its tokens of two rare words (2, 3); kind 1 passes.

    Kind 2 of what comes are the bucket's kept draws.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = shared.value
        common, samples = model.common, model.samples
        pieces, names, passed, kept = [], [], [], {}
        for f in batches:
            for part, kind, data in zip(*(f.column(c).to_pylist() for c in ("part", "kind", "data")), strict=True):
                if kind == 1:
                    passed.append((part, 1, data))
                elif kind == 2:
                    kept[part] = data
                else:
                    pieces.append(_unpack(data, *_PAIRS, np.uint32, np.uint32, np.uint32, np.uint32, np.uint8))
                    names.append(part)
        if passed:
            yield _rows(passed)
        if not pieces:
            return
        # training counts of each piece's pairs: the tokens of texts that are learned from
        learned = []
        for x in pieces:
            flags = np.unpackbits(x[11]).astype(np.int64)
            sums = [np.concatenate([[0], np.cumsum(c)]) for c in (flags[x[7]] * x[8], flags[x[9]])]
            ends = [np.cumsum(x[i].astype(np.int64)) for i in (2, 6)]
            learned.append([x[0], x[1], sums[0][ends[0]] - sums[0][ends[0] - x[2]], x[3], x[4], x[5], sums[1][ends[1]] - sums[1][ends[1] - x[6]]])
        every, back, back2 = _gather(learned, common.bits)
        del learned
        for x in pieces:  # what _gather has
            x[0] = x[1] = x[3] = x[4] = x[5] = None
        pairs = _trained(every)
        drawn = [pairs.kept(kept.get(i)) for i in range(len(samples))]
        pair_score = np.log10(model.pairs(every.v, every.w, every.c, [_spread(every.c, d.t) for d in drawn]))

        followed = every.by_owner(every.owner, np.where((every.kind == _OF_COMMON) | (every.kind == _OF_RARE), every.n, 0))
        count = every.by_owner(every.owner, np.where((every.kind == _IN_COMMON) | (every.kind == _IN_RARE), every.n, 0))
        parent = np.stack([common.parent(d.customers, d.tables, s.end) for d, s in zip(drawn, samples, strict=True)])
        spare = np.stack([(STRENGTH + DISCOUNT * d.own) / (STRENGTH + followed) for d in drawn])
        record = np.zeros(len(every.owner))
        for kind in (_OF_COMMON, _IN_COMMON):
            at = np.flatnonzero(every.kind == kind)
            o, other, c = every.owner[at], every.other[at].astype(np.int64), every.n[at]
            p = np.zeros(len(at))
            for i, (s, d) in enumerate(zip(samples, drawn, strict=True)):
                t = _spread(c, d.records[kind])
                if kind == _OF_COMMON:
                    p += (c - DISCOUNT * t) / (STRENGTH + followed[o]) + spare[i, o] * s.end.p[other]
                else:
                    p += (c - DISCOUNT * t) / (STRENGTH + common.followed[other]) + model.spare(s)[other] * parent[i, o]
            record[at] = np.log10(p / len(samples))
        at = np.flatnonzero(every.kind == _OF_RARE)
        seats = sum(_spread(every.n[at], d.records[_OF_RARE]) for d in drawn) / len(drawn)
        record[at] = (every.n[at] - DISCOUNT * seats) / (STRENGTH + followed[every.owner[at]])
        smoothed = common.smoothed(count)

        for part, x, a, b in zip(names, pieces, back, back2, strict=True):
            n = 8 * len(x[11])
            sums = np.bincount(x[7], np.repeat(pair_score[a], x[2]) * x[8], n).astype(float)
            row = np.repeat(b, x[6])
            kind, owner, who = every.kind[row], every.owner[row], x[9]
            sums += np.bincount(who, np.where(kind < _OF_RARE, record[row], 0), n)
            dish = np.flatnonzero((kind == _IN_COMMON) | (kind == _IN_RARE))
            known, base = (np.bincount(who[dish], y[owner[dish]], n).astype(float) for y in (count > 0, smoothed))
            hit, rare = np.flatnonzero(sums), np.flatnonzero(base)
            out = [(part, 0, _pack(_gaps(hit), sums[hit].astype(np.float32), _gaps(rare), _narrow(known[rare]), base[rare]))]
            at = np.flatnonzero(kind == _OF_RARE)
            if len(at):
                at = at[np.argsort(x[10][at], kind="stable")]
                out.append((part, 2, _pack(_gaps(x[10][at].astype(np.int64)), *np.stack([record[row[at]], *spare[:, owner[at]]]).astype(np.float32))))
            at = np.flatnonzero(kind == _IN_RARE)
            if len(at):
                at = at[np.argsort(x[10][at], kind="stable")]
                out.append((part, 3, _pack(_gaps(x[10][at].astype(np.int64)), *parent[:, owner[at]].astype(np.float32))))
            yield _rows(out)

    return run


def _summed(tokens: int, samples: int):
    """Each block's texts with the sums of all buckets; rows are sorted by part and come with the texts (kind 1) first."""

    def finish(head, pairs) -> pa.RecordBatch:
        ids, there, held, counts, known, base, score, rare = head
        if len(rare):
            own, spare, parent = pairs
            p = (own + spare * parent).mean(0)
            score = score + np.bincount(rare, np.log10(p), len(ids))
        columns = [pa.array(ids, mask=there == 0), pa.array(held.astype(bool)), pa.array(counts), pa.array(known), pa.array(np.full(len(ids), tokens)), pa.array(base), pa.array(score)]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, head, pairs = None, None, None
        for f in batches:
            for part, kind, data in zip(*(f.column(c).to_pylist() for c in ("part", "kind", "data")), strict=True):
                if kind == 1:
                    if head is not None:
                        yield finish(head, pairs)
                    now, head = part, [x.copy() for x in _unpack(data, np.int64, np.uint8, np.uint8, np.int64, np.int64, float, float, np.uint32)]
                    pairs = np.zeros(len(head[7])), np.zeros((samples, len(head[7]))), np.zeros((samples, len(head[7])))
                    continue
                assert part == now
                if kind == 0:
                    hit, score, rare, known, base = _unpack(data, np.uint32, np.float32, np.uint32, np.uint32, float)
                    head[6][np.cumsum(hit)] += score
                    rare = np.cumsum(rare)
                    head[4][rare] += known
                    head[5][rare] += base
                elif kind == 2:
                    at, own, *spare = _unpack(data, np.uint32, *[np.float32] * (1 + samples))
                    at = np.cumsum(at)
                    pairs[0][at], pairs[1][:, at] = own, np.stack(spare)
                else:
                    at, *parent = _unpack(data, np.uint32, *[np.float32] * samples)
                    pairs[2][:, np.cumsum(at)] = np.stack(parent)
        if head is not None:
            yield finish(head, pairs)

    return run


# ---------------------------------------------------------------- the whole


def train(slim: DataFrame, sample_rare: bool) -> tuple[Model, DataFrame]:
    """Counts and samples, and the kept draws (bucket, part, kind, data); slim: text, learns."""
    spark = slim.sparkSession
    texts = slim.where("learns").select("text")
    counted = checkpointed(texts.mapInArrow(_lean(_words), "word long, n long").groupBy("word").agg(F.sum("n").alias("n")))
    end = F.sum(F.when(F.col("word") == int(_END.astype(np.int64)), F.col("n")).otherwise(0))
    vocabulary, tokens, ends = counted.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(end, F.lit(0))).first()
    found = counted.where(F.col("n") * SHARE >= tokens).toArrow()
    words = np.concatenate([found["word"].to_numpy().astype(np.int64).view(np.uint64), [_START]])
    count = np.concatenate([found["n"].to_numpy().astype(np.int64), [0]])
    order = np.lexsort((words, -count))
    words, count = words[order], count[order]
    followed = np.where(words == _END, 0, np.where(words == _START, ends, count))
    homes = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(homes, -(-tokens // BUCKET_TOKENS))
    common = Common(words, count, followed, tokens, vocabulary, buckets, homes)
    sc = spark.sparkContext
    shared = sc.broadcast(common)

    # a sweep's tasks, then those that add sums
    parts = homes + -(-(2 * len(words) + 2) // _CHUNK)
    dealt = texts.mapInArrow(_lean(_dealt_pairs(shared)), "bucket int, data binary").repartitionById(parts, F.col("bucket") % homes)
    merged = dealt.mapInArrow(_lean(_merged(shared)), "bucket int, v long, w long, n long, data string")
    # one element for each partition and batch, so that pairs and messages meet without another Python worker
    single = BatchedSerializer(CPickleSerializer(), 1)
    stored = (merged.rdd if tokens else sc.parallelize([], parts)).mapPartitions(_held)._reserialize(single)
    checkpoint_folder(spark)
    stored.checkpoint()
    stored.take(1)  # any job has the whole written
    # nothing refers to what was dealt any more, so that its files can go
    stored = RDD(stored._jrdd, sc, single)
    del dealt, merged
    deal = lambda told: told.partitionBy(parts, int).values()
    told = deal(stored.mapPartitions(_lean(_started(shared)))) if sample_rare else sc.parallelize([], parts)
    state, samples = common.first(), []
    for sweep in range(BURN + SAMPLES):
        sent = sc.broadcast(state)
        kept = sweep - BURN if sweep >= BURN else None
        rows = stored.zip(told.mapPartitions(_at_once)._reserialize(single))
        # dealt once: what was written for the sums also serves the next sweep and the scores
        told = deal(rows.mapPartitions(_lean(_swept(shared, sent, sample_rare, kept, sweep == BURN + SAMPLES - 1))))
        got = sc.runJob(told, _added, range(homes, parts))
        sums = np.zeros(2 * len(words) + 2, np.int64)
        for chunk, data in got:
            x = np.frombuffer(data, np.int64)
            sums[chunk * _CHUNK : chunk * _CHUNK + len(x)] += x
        n = len(words)
        sample, state = common.next(state, sums[:n], sums[n : 2 * n], int(sums[-2]), int(sums[-1]))
        if sweep >= BURN:
            samples.append(sample)
    model = Model(common, samples)
    hot = sorted(stored.flatMap(lambda x: x[1]).collect())
    if hot:
        v, w, c = (np.array(x, np.int64) for x in zip(*hot, strict=True))
        tables = [draw_tables(c, DISCOUNT * s.start.x[v] * s.start.p[w], DISCOUNT, keyed(words[v], words[w], s.start.sweep)) for s in samples]
        model.hot = (v.astype(np.uint64) << np.uint64(32)) | w.astype(np.uint64)
        model.hot_score = np.log10(model.pairs(v, w, c, tables))
    return model, spark.createDataFrame(told.mapPartitions(_draws), "bucket int, part long, kind int, data binary", verifySchema=False)


def score(docs: DataFrame, learns: Column, held_out: Column, sample_rare: bool = False) -> DataFrame:
    """For each row: doc_id, held_out boolean, n_tokens, n_known, train_tokens long, base_score, score double.

    Learns from the texts of rows where ``learns`` holds (null: doesn't), scores all. A text's tokens are its words,
    A-Z lower-cased, then one end; a null text has the end alone. ``score`` is the model's log10 probability of the
    text, ``base_score`` that of smoothed counts; without training rows both are those of a uniform guess. Rows keep
    their number, repeated ones and null doc_ids too; an empty table gives an empty one; other columns aren't read. A
    very long text is a block by itself. ``sample_rare``: the tables of pairs of two rare words are sampled with all
    others, else such a pair always sits at one.
    """
    spark = docs.sparkSession
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce(learns, F.lit(False)).alias("learns"), F.coalesce(held_out, F.lit(False)).alias("held"))
    model, draws = train(slim, sample_rare)
    shared = spark.sparkContext.broadcast(model)
    buckets = model.common.buckets
    dealt = slim.mapInArrow(_lean(_dealt_texts(shared)), "bucket int, part long, kind int, data binary")
    scored = dealt.unionAll(draws).repartitionById(buckets, F.col("bucket")).mapInArrow(_lean(_scored(shared)), "part long, kind int, data binary")
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    home = scored.repartition(buckets, "part").sortWithinPartitions("part", (F.col("kind") != 1).cast("int"))
    return home.mapInArrow(_summed(model.common.tokens, len(model.samples)), schema)
