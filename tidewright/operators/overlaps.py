"""Pairs of sets with a Jaccard similarity of at least a threshold, and what is asked of them, block by block.

The sets of a group are dealt by hash to blocks of about BLOCK sets and MOST members; each two blocks of a group meet in one call, so a large group is many
calls and what travels is each block once for every other. Within a call the shared members of all pairs are counted exactly: members that both blocks have
often by a product of 0/1 matrices, the others by their postings. Only what is asked for leaves the call; the pairs themselves do only where they are the result.
Similarities are whole billionths, rounded half up from whole numbers.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from tidewright.session import shuffle_partitions

BLOCK, MOST, ROWS = 2048, 1_000_000, 512
#: Members that at least one in so many pairs of a meeting shares go through the product; entries that are added and words that leave at once.
SPARSE, ENTRIES, WORDS = 500, 2_000_000, 2_000_000
UNIT = 1_000_000_000


class Block:
    """Sets in ascending size; `at` holds each set's members as positions in `words`, in their order."""

    def __init__(self, data: bytes):
        b = pa.ipc.open_stream(data).read_next_batch()
        self.pages, topics = b.column(0), b.column(1)
        self.starts = topics.offsets.to_numpy().astype(np.int64)
        self.at, self.words = topics.values.indices.to_numpy(), topics.values.dictionary
        self.n = np.diff(self.starts)
        self.row = np.repeat(np.arange(len(self.n)), self.n)


def _pack(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row: the key and the bytes of a Block."""
    t = pa.Table.from_batches(list(batches)).combine_chunks()
    t = t.take(pc.sort_indices(pc.list_value_length(t["topics"]))).combine_chunks().to_batches()[0]
    pages, topics = t.column("page"), t.column("topics")
    starts = np.concatenate([[0], np.cumsum(pc.list_value_length(topics).to_numpy())]).astype(np.int32)
    rows = pa.record_batch([pages, pa.ListArray.from_arrays(pa.array(starts), topics.flatten().dictionary_encode())], names=["page", "topics"])
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
        w.write_batch(rows)
    yield pa.record_batch([*(pa.array([k.as_py()], k.type) for k in key), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=[*(f"_w{i}" for i in range(len(key) - 2)), "_of", "_block", "data"])


def billionths(c, u):
    return (2 * UNIT * c + u) // (2 * u)


class Meeting:
    """x, y: blocks; same: they are one. least: in billionths."""

    def __init__(self, x: Block, y: Block, same: bool, least: int, sparse: int = SPARSE):
        self.x, self.y, self.same, self.least, self.sparse = x, y, same, least, sparse
        size = len(x.words)
        self.xa = x.at
        self.ya = y.at if same else pc.fill_null(pc.index_in(y.words, value_set=x.words), -1).to_numpy()[y.at]
        known = self.ya >= 0
        met = np.bincount(self.xa, minlength=size) * np.bincount(self.ya[known], minlength=size)
        dense = met * sparse >= max(1, len(x.n) * len(y.n))
        col = np.where(dense, np.cumsum(dense) - 1, -1)
        self.a, self.b = np.zeros((len(x.n), dense.sum() + 2), np.float32), np.zeros((dense.sum() + 2, len(y.n)), np.float32)
        k = dense[self.xa]
        self.a[x.row[k], col[self.xa[k]]] = 1
        k = known.copy()
        k[known] = dense[self.ya[known]]
        self.b[col[self.ya[k]], y.row[k]] = 1
        rare = (met > 0) & ~dense
        k = known.copy()
        k[known] = rare[self.ya[known]]
        order = np.argsort(self.ya[k], kind="stable")
        self.post, self.lens = y.row[k][order], np.bincount(self.ya[k], minlength=size)
        self.ptr = np.cumsum(self.lens) - self.lens
        k = rare[self.xa]
        self.rrow, self.rword = x.row[k], self.xa[k]

    def counts(self, s: int, e: int, lo: int, hi: int) -> np.ndarray:
        """Shared members of rows s to e with columns lo to hi, plus what the last two columns of a and rows of b add. Whole numbers below 2 ** 24."""
        c = self.a[s:e] @ self.b[:, lo:hi]
        flat, wide = c.reshape(-1), hi - lo
        i, j = np.searchsorted(self.rrow, [s, e])
        ends = np.cumsum(self.lens[self.rword[i:j]])
        while i < j:
            k = max(1, np.searchsorted(ends, (ends[0] - self.lens[self.rword[i]]) + ENTRIES))
            w = self.rword[i : i + k]
            n = self.lens[w]
            col = self.post[np.arange(n.sum()) + np.repeat(self.ptr[w] - np.cumsum(n) + n, n)]
            row = np.repeat(self.rrow[i : i + k] - s, n)
            if wide < self.b.shape[1]:
                inside = (col >= lo) & (col < hi)
                row, col = row[inside], col[inside]
            np.add.at(flat, row * wide + col - lo, np.float32(1))
            i, ends = i + k, ends[k:]
        return c

    def related(self, half: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(rows, columns, similarity) of at least `least`, some at a time. half: of a block with itself, each pair once."""
        t = max(2 * self.least - 1, 0)
        hx, hy = (b.n * t // (2 * UNIT + t) for b in (self.x, self.y))  # a pair shares at least the sum of both
        self.a[:, -2], self.a[:, -1], self.b[-2], self.b[-1] = -hx, 1, 1, -hy
        for s in range(0, len(hx), ROWS):
            e = min(s + ROWS, len(hx))
            lo = np.searchsorted(self.y.n, self.x.n[s] * t // (2 * UNIT))
            hi = np.searchsorted(self.y.n, -(-self.x.n[e - 1] * 2 * UNIT // t), "right") if t else len(hy)
            lo = max(lo, s) if self.same and half else lo
            if lo >= hi:
                continue
            c = self.counts(s, e, lo, hi)
            k = np.flatnonzero(c >= 0)
            row, col = s + k // (hi - lo), lo + k % (hi - lo)
            n = np.rint(c.reshape(-1)[k]).astype(np.int64) + hx[row] + hy[col]
            sim = billionths(n, self.x.n[row] + self.y.n[col] - n)
            k = (sim >= self.least) & (n > 0)
            if self.same:
                k &= row < col if half else row != col
            yield row[k], col[k], sim[k]

    def best(self, ranks: tuple[np.ndarray, np.ndarray]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """(side, sets, partners, similarity): for each set the most similar one of the other block, of equals that of the lowest rank; some at a time."""
        self.a[:, -2:], self.b[-2:] = 0, 0
        for s in range(0, len(self.x.n), ROWS):
            e = min(s + ROWS, len(self.x.n))
            c = self.counts(s, e, 0, len(self.y.n))
            if self.same:
                c[np.arange(e - s), np.arange(s, e)] = 0
            ratio = c / ((self.x.n[s:e, None] + self.y.n[None]).astype(np.float32) - c)
            for side in (0,) if self.same else (0, 1):
                q, n = (ratio.T, c.T) if side else (ratio, c)
                top = q.max(1)
                # What may round to the same billionths is looked at in whole numbers.
                row, col = np.nonzero((q >= (top * (1 - 2e-6) - 2e-9)[:, None]) & (n > 0))
                m = n[row, col].astype(np.int64)
                own, far = (row, s + col) if side else (s + row, col)
                sizes = (self.y.n[own], self.x.n[far]) if side else (self.x.n[own], self.y.n[far])
                sim = billionths(m, sizes[0] + sizes[1] - m)
                order = np.lexsort((ranks[1 - side][far], -sim, own))
                first = order[np.diff(own[order], prepend=-1) > 0]
                yield side, own[first], far[first], sim[first]


def _ranks(x: Block, y: Block, same: bool) -> tuple[np.ndarray, np.ndarray]:
    both = x.pages if same else pa.concat_arrays([x.pages, y.pages])
    rank = np.empty(len(both), np.int64)
    rank[pc.sort_indices(both).to_numpy()] = np.arange(len(both))
    return (rank, rank) if same else (rank[: len(x.n)], rank[len(x.n) :])


def _shared(m: Meeting, side: np.ndarray, row: np.ndarray, col: np.ndarray) -> pa.Array:
    """Members of the second set of each pair that the first has, too, in the second's order. side: the second is that of the column."""
    out = []
    for flag, b, to, b_at, a_at, a, second, first in ((True, m.y, m.x, m.ya, m.xa, m.x, col, row), (False, m.x, m.y, m.xa, m.ya, m.y, row, col)):
        k = np.flatnonzero(side == flag)
        if not len(k):
            continue
        n = b.n[second[k]]
        at = np.arange(n.sum()) + np.repeat(b.starts[second[k]] - np.cumsum(n) + n, n)
        word = b_at[at]
        # Sorted (first, word) codes would cost a search for each; the first sets of a chunk are few, so a table of theirs answers at once.
        firsts, place = np.unique(first[k], return_inverse=True)
        table = np.zeros((len(firsts), len(m.x.words) + 1), bool)
        f = a.n[firsts]
        table[np.repeat(np.arange(len(firsts)), f), a_at[np.arange(f.sum()) + np.repeat(a.starts[firsts] - np.cumsum(f) + f, f)]] = True
        table[:, -1] = False  # members that the other block lacks are -1
        has = table[np.repeat(place, n), word]
        ends = np.concatenate([[0], np.cumsum(has)])[np.concatenate([[0], np.cumsum(n)])].astype(np.int32)
        out.append((k, pc.binary_join(pa.ListArray.from_arrays(pa.array(ends), m.x.words.take(pa.array(word[has]))), ",")))
    if not out:
        return pa.array([], pa.string())
    back = np.argsort(np.concatenate([k for k, _ in out]))
    return pa.concat_arrays([x for _, x in out]).take(pa.array(back))


def _pairs(m: Meeting) -> Iterator[list]:
    rx, ry = _ranks(m.x, m.y, m.same)
    for row, col, sim in m.related(True):
        side = rx[row] < ry[col]
        order = np.lexsort((np.where(side, row, col), np.where(side, col, row), side))  # those of one second set together
        row, col, sim, side = row[order], col[order], sim[order], side[order]
        # As many pairs at once as their members and the table of their first sets allow.
        cost = np.cumsum(np.where(side, m.y.n[col], m.x.n[row]))
        most = max(1, 32 * WORDS // (len(m.x.words) + 1))
        i = 0
        while i < len(row):
            j = max(i + 1, min(i + most, np.searchsorted(cost, (cost[i - 1] if i else 0) + WORDS, "right")))
            r, c, s, k = row[i:j], col[i:j], sim[i:j], side[i:j]
            x, y = m.x.pages.take(pa.array(r)), m.y.pages.take(pa.array(c))
            yield [pc.if_else(pa.array(k), x, y), pc.if_else(pa.array(k), y, x), pa.array(s), _shared(m, k, r, c)]
            i = j


def _sides(m: Meeting) -> Iterator[list]:
    """Each pair with the number of sides from which it is met and of the similarities found; either side counts for itself."""
    rx, ry = _ranks(m.x, m.y, m.same)
    wide = len(m.y.n)
    met = [(r * wide + c, s) for r, c, s in m.related(False)]
    if m.same:
        met = [(np.minimum(k // wide, k % wide) * wide + np.maximum(k // wide, k % wide), s) for k, s in met]
    else:
        met += [(r * wide + c, s) for c, r, s in Meeting(m.y, m.x, False, m.least, m.sparse).related(False)]
    key, sim = (np.concatenate([x[i] for x in met]) if met else np.zeros(0, np.int64) for i in (0, 1))
    order = np.lexsort((sim, key))
    key, sim = key[order], sim[order]
    new = np.diff(key, prepend=-1) > 0
    starts = np.flatnonzero(new)
    sides = np.diff(starts, append=len(key))
    kinds = np.add.reduceat((new | (np.diff(sim, prepend=-1) != 0)).astype(np.int64), starts) if len(starts) else starts
    row, col = key[starts] // wide, key[starts] % wide
    x, y, k = m.x.pages.take(pa.array(row)), m.y.pages.take(pa.array(col)), pa.array(rx[row] < ry[col])
    yield [pc.if_else(k, x, y), pc.if_else(k, y, x), pa.array(sides.astype(np.int64)), pa.array(kinds)]


def _linked(m: Meeting) -> Iterator[list]:
    seen = np.zeros(len(m.x.n), bool), np.zeros(len(m.y.n), bool)
    for row, col, _ in m.related(True):
        seen[0][row] = True
        seen[0 if m.same else 1][col] = True
    yield [m.x.pages.filter(pa.array(seen[0]))]
    if not m.same:
        yield [m.y.pages.filter(pa.array(seen[1]))]


def _best(m: Meeting) -> Iterator[list]:
    ranks, found = _ranks(m.x, m.y, m.same), ([], [])
    for side, own, far, sim in m.best(ranks):
        found[side].append((own, far, sim))
    for side, b, other in ((0, m.x, m.y), (1, m.y, m.x)):
        if found[side]:
            own, far, sim = (np.concatenate([f[i] for f in found[side]]) for i in range(3))
            order = np.lexsort((ranks[1 - side][far], -sim, own))
            first = order[np.diff(own[order], prepend=-1) > 0]
            yield [b.pages.take(pa.array(own[first])), other.pages.take(pa.array(far[first])), pa.array(sim[first])]


def _groups(m: Meeting) -> Iterator[list]:
    """Pages that are related here, with the number of their links here and the lowest page they are connected with here."""
    shift, size = (0, len(m.x.n)) if m.same else (len(m.x.n), len(m.x.n) + len(m.y.n))
    rank = np.concatenate(_ranks(m.x, m.y, m.same))[:size]
    met = [(r, c + shift) for r, c, _ in m.related(True)]
    u, v = (np.concatenate([x[i] for x in met]) if met else np.zeros(0, np.int64) for i in (0, 1))
    links = np.bincount(u, minlength=size) + np.bincount(v, minlength=size)
    head = np.arange(size)  # of places in the order of pages
    u, v = rank[u], rank[v]
    while len(u):
        low = np.minimum(head[u], head[v])
        np.minimum.at(head, head[u], low)
        np.minimum.at(head, head[v], low)
        while (head[head] != head).any():
            head = head[head]
        apart = head[u] != head[v]
        u, v = u[apart], v[apart]
    pages = m.x.pages if m.same else pa.concat_arrays([m.x.pages, m.y.pages])
    place = np.empty(size, np.int64)
    place[rank] = np.arange(size)
    k = np.flatnonzero(links)
    yield [pages.take(pa.array(k)), pages.take(pa.array(place[head[rank[k]]])), pa.array(links[k])]


WHAT: dict[str, tuple[Callable[[Meeting], Iterator[list]], str]] = {
    "pairs": (_pairs, "a {0}, b {0}, billionths long, shared string"),
    "sides": (_sides, "page {0}, other {0}, sides long, similarities long"),
    "linked": (_linked, "page {0}"),
    "best": (_best, "page {0}, other {0}, billionths long"),
    "groups": (_groups, "page {0}, head {0}, links long"),
}


def meet(pages: DataFrame, least: float, within: Sequence[str], what: str, block: int = BLOCK, sparse: int = SPARSE) -> DataFrame:
    """What is asked of the pairs of pages with a similarity of at least `least` > 0. pages: page, topics (distinct); it is read twice.
    within: columns of pages that meet each other only; where one is null a page meets none, as one without topics."""
    run, schema = WHAT[what]
    threshold = round(round(least, 9) * UNIT)
    by = [F.col(c).alias(f"_w{i}") for i, c in enumerate(within)] or [F.lit(0).alias("_w0")]
    keys = [f"_w{i}" for i in range(len(by))]
    p = pages.select(*by, "page", "topics").dropna(subset=keys).where(F.size("topics") > 0)
    blocks = F.ceil(F.greatest(F.count("*") / block, F.sum(F.size("topics")) / MOST)).cast("int")
    large = F.broadcast(p.groupBy(*keys).agg(blocks.alias("_of")).where("_of > 1"))  # as many rows as there are blocks at most
    p = p.join(large, keys, "left").withColumn("_of", F.coalesce("_of", F.lit(1))).withColumn("_block", F.pmod(F.xxhash64("page"), "_of").cast("int"))
    kinds = dict(p.dtypes)
    named = ", ".join(f"{k} {kinds[k]}" for k in [*keys, "_of", "_block"])
    packed = p.groupBy(*keys, "_of", "_block").applyInArrow(_pack, f"{named}, data binary")
    dealt = packed.select(*keys, "_block", "data", F.explode(F.sequence(F.lit(0), F.col("_of") - 1)).alias("_other"))
    dealt = dealt.select(*keys, F.least("_block", "_other").alias("_i"), F.greatest("_block", "_other").alias("_j"), "_block", "data")

    def call(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = {b: d for t in batches for b, d in zip(t.column("_block").to_pylist(), t.column("data").to_pylist())}
        i, j = key[-2].as_py(), key[-1].as_py()
        if i in own and j in own:
            x = Block(own[i])
            for columns in run(Meeting(x, x if i == j else Block(own[j]), i == j, threshold, sparse)):
                yield pa.record_batch(columns, names=names)

    out = schema.format(kinds["page"])
    names = [c.split(" ")[0] for c in out.split(", ")]
    # Small blocks mean much work, so the number of tasks follows the cores and not the bytes.
    return dealt.repartition(3 * shuffle_partitions(pages.sparkSession), *keys, "_i", "_j").groupBy(*keys, "_i", "_j").applyInArrow(call, out)
