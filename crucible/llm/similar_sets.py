"""Problem 5: all pairs of records whose sets overlap above a threshold."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from crucible.operators.text import stripped
from crucible.runtime import drop_tables, release, tables_of, written

_P = 0x100000001B3
#: Bits of a set's parity bitmap.
BITS = 512
#: Levels of a tree below the shallowest prefix that is compared, and the bits by which each is told apart.
DEEPER, LEVEL_BITS = 3, 10
#: Sets of one neighbourhood that a task compares at once; larger neighbourhoods are compared block by block.
HOT = 2048
#: Leaves that a round of trees makes at most, or two trees' where there are more texts; a round's files go before the next.
LEAVES = 250_000


def forest_shape(n: int, threshold: float, recall: float, background: float = 0.07) -> tuple[int, int]:
    """(shallowest depth, trees) of a forest for n sets.

    The depth grows until two unrelated sets (similarity `background`) share a prefix in a tree less often than once a
    record; then as many trees are grown as a pair exactly at the threshold needs to share it in at least one with probability
    `recall`. More similar pairs share longer prefixes, in more trees.
    """
    depth = max(2, math.ceil(math.log(max(n, 2)) / -math.log(background)))
    return depth, math.ceil(math.log(1 - recall) / math.log(1 - threshold**depth))


class _Texts:
    """Texts as payloads of leaves: pairs stay whose sets of pieces are similar enough, with that similarity.

    The bits in which two parity bitmaps differ are at most the pieces in which the sets differ, which tells most unrelated
    pairs apart; the exact sets decide on the others. Bitmaps are made for the given rows once, sets as needed.
    """

    array, list_of, value = pa.string(), "string", ("similarity", "double", pa.float64())

    def __init__(self, width: int, threshold: float):
        self.width, self.threshold = width, threshold

    def ready(self, texts: np.ndarray, rows: np.ndarray):
        bits, size = np.zeros((len(texts), BITS // 64), np.uint64), np.zeros(len(texts), np.int64)
        for at in range(0, len(rows), 1024):
            own = rows[at : at + 1024]
            h, begin = _piece_hashes(texts[own].tolist(), self.width)
            bits[own], size[own] = _bitmaps(h, begin).view(np.uint64), np.diff(begin)
        sets: dict[int, frozenset[str]] = {}

        def pieces(k: int) -> frozenset[str]:
            if k not in sets:
                t = texts[k]
                sets[k] = frozenset(t[i : i + self.width] for i in range(len(t) - self.width + 1))
            return sets[k]

        def judge(i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, list[float]]:
            differ = np.bitwise_count(bits[i] ^ bits[j]).sum(axis=1, dtype=np.int64)
            most = (size[i] + size[j]) * ((1 - self.threshold) / (1 + self.threshold)) + 1e-6  # pieces in which similar sets can differ
            keep, out = [], []
            for k in np.flatnonzero(differ <= most).tolist():
                p, q = pieces(int(i[k])), pieces(int(j[k]))
                c = len(p & q)
                v = c / (len(p) + len(q) - c)
                if v >= self.threshold:
                    keep.append(k)
                    out.append(v)
            return np.array(keep, np.int64), out

        return judge


class _Tails:
    """Packed tails as payloads of leaves: all pairs stay, with the levels that they share."""

    array, list_of, value = pa.int32(), "int", ("deeper", "byte", pa.int8())

    def ready(self, tails: np.ndarray, rows: np.ndarray):
        return lambda i, j: (np.arange(len(i)), _lcp(tails[i], tails[j]))


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 32-bit numbers in which every bit depends on every other."""
    x = (x ^ (x >> np.uint32(16))) * np.uint32(0x7FEB352D)
    x = (x ^ (x >> np.uint32(15))) * np.uint32(0x846CA68B)
    return x ^ (x >> np.uint32(16))


def _piece_hashes(texts: list[str], width: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct 64-bit hashes of each text's pieces, one after the other, and where each text's begin."""
    lengths = np.array([len(t) for t in texts])
    code = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).astype(np.uint64)
    own = np.repeat(np.arange(len(texts)), lengths)
    n = max(0, len(code) - width + 1)
    h = np.zeros(n, np.uint64)
    for j in range(width):
        h += code[j : n + j] * np.uint64(pow(_P, j, 1 << 64))
    inside = own[:n] == own[width - 1 :][:n] if n else np.zeros(0, bool)
    h, own = h[inside], own[:n][inside]
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    up = np.uint64(max(1, (len(texts) - 1).bit_length()))
    order = np.argsort((own.astype(np.uint64) << (np.uint64(64) - up)) | (h >> up))  # one key of text and hash sorts faster than two
    h, own = h[order], own[order]
    new = np.r_[True, (h[1:] != h[:-1]) | (own[1:] != own[:-1])] if len(h) else np.zeros(0, bool)
    h, own = h[new], own[new]
    return h, np.searchsorted(own, np.arange(len(texts) + 1))


def _bitmaps(h: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """The parity bitmap of each text's pieces."""
    n = len(begin) - 1
    own = np.repeat(np.arange(n), np.diff(begin))
    count = np.bincount(own * BITS + (h >> np.uint64(40)).astype(np.int64) % BITS, minlength=n * BITS).reshape(-1, BITS)
    return np.packbits((count & 1).astype(np.uint8), axis=1, bitorder="little").view(np.int64)


def _minima(h: np.ndarray, begin: np.ndarray, mul: np.ndarray, add: np.ndarray) -> np.ndarray:
    """The mixed minimum (function, text) of each text's pieces under each function."""
    some = np.flatnonzero(np.diff(begin))
    least = np.zeros((len(mul), len(begin) - 1), np.uint32)
    if len(some):
        low = h.astype(np.uint32)
        for i in range(len(mul)):
            least[i, some] = np.minimum.reduceat(low * mul[i] + add[i], begin[some])
    return _mix(least)


def _functions(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return rng.integers(1, 1 << 32, n, dtype=np.uint32) | np.uint32(1), rng.integers(0, 1 << 32, n, dtype=np.uint32)


def _packed(trees: np.ndarray, value: np.ndarray, depth: int) -> np.ndarray:
    """heads (tree, text): the tree's number and its first `depth` minima, of value (tree, level, text)."""
    bits_each = (63 - 10) // depth
    head = np.repeat(trees[:, None], value.shape[2], axis=1)
    for j in range(depth):
        head = (head << bits_each) | (value[:, j] >> (32 - bits_each))
    return head


def _leaves(width: int, depth: int, trees: int, first: int, last: int, seed: int):
    """Worker: (tid, text) to the leaves (head, text, tid, size) of the trees from `first` up to `last`, heads being those of `_sketches`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mul, add = (x.reshape(trees, -1)[first:last, :depth].ravel() for x in _functions((depth + DEEPER) * trees, seed))
        for whole in batches:
            for at in range(0, whole.num_rows, 2048):
                b = whole.slice(at, 2048)
                h, begin = _piece_hashes(b.column(1).to_pylist(), width)
                size = pa.array(np.diff(begin).astype(np.int32))
                value = _minima(h, begin, mul, add).reshape(last - first, depth, -1).astype(np.int64)
                for head in _packed(np.arange(first, last), value, depth):
                    yield pa.RecordBatch.from_arrays([pa.array(head), b.column(1), b.column(0), size], ["head", "text", "tid", "size"])

    return run


def _sketches(width: int, depth: int, trees: int, seed: int):
    """Worker: (tid, text) to (tid, text, size, heads, tails, bits).

    A tree's signature is a row of mixed minima. heads are the tree and the first `depth` of them, tails the next DEEPER, both
    packed so that numbers are in the signatures' lexicographic order; bits is the parity bitmap of the pieces.
    """
    levels = depth + DEEPER

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mul, add = _functions(levels * trees, seed)
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                b = whole.slice(at, 256)
                texts = b.column(1).to_pylist()
                h, begin = _piece_hashes(texts, width)
                sizes = np.diff(begin).astype(np.int32)
                value = _minima(h, begin, mul, add).reshape(trees, levels, len(texts)).astype(np.int64)
                head = _packed(np.arange(trees, dtype=np.int64), value, depth)
                tail = np.zeros_like(head)
                for j in range(depth, levels):
                    tail = (tail << LEVEL_BITS) | (value[:, j] >> (32 - LEVEL_BITS))
                packed = _bitmaps(h, begin)
                lists = [pa.FixedSizeListArray.from_arrays(pa.array(np.ascontiguousarray(v).ravel(), t), n).cast(pa.list_(t)) for v, n, t in ((head.T, trees, pa.int64()), (tail.T.astype(np.int32), trees, pa.int32()), (packed, BITS // 64, pa.int64()))]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(sizes), *lists], ["tid", "text", "size", "heads", "tails", "bits"])

    return run


def _lcp(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Levels that two packed tails share before they differ."""
    x, out, same = p ^ q, np.zeros(len(p), np.int8), np.ones(len(p), bool)
    for j in range(DEEPER):
        same = same & (x >> (LEVEL_BITS * (DEEPER - 1 - j)) == 0)
        out += same
    return out


def _schema(load: _Texts | _Tails) -> str:
    """Of what neighbourhoods give."""
    return f"x long, y long, {load.value[0]} {load.value[1]}, head long, block int, tids array<long>, sizes array<int>, loads array<{load.list_of}>"


def _neighbours(threshold: float, load: _Texts | _Tails):
    """Worker: leaves (head, payload, tid, size), sorted by head, to neighbouring pairs (x, y, value) and blocks of hot neighbourhoods.

    A neighbourhood is a run of leaves of one head, that is of a common prefix of the shallowest depth. One of more than HOT
    leaves isn't compared here but given out in blocks.
    """
    names = [x.split()[0] for x in _schema(load).split(", ")]

    def pairs(tid: np.ndarray, size: np.ndarray, judge, i: np.ndarray, j: np.ndarray) -> pa.RecordBatch | None:  # noqa: ANN001
        ok = (size[i] >= size[j] * threshold - 1) & (size[j] >= size[i] * threshold - 1) & (tid[i] != tid[j])
        i, j = i[ok], j[ok]
        if not len(i):
            return None
        keep, value = judge(i, j)
        i, j, n = i[keep], j[keep], len(keep)
        if not n:
            return None
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(tid[i], tid[j])), pa.array(np.maximum(tid[i], tid[j])), pa.array(value, load.value[2]), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.list_(pa.int64())), pa.nulls(n, pa.list_(pa.int32())), pa.nulls(n, pa.list_(load.array))], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = [np.zeros(0, t) for t in (np.int64, load.array.to_pandas_dtype(), np.int64, np.int32)]
        hot: tuple[int, int] | None = None  # the head whose leaves go out in blocks, and its next block

        def give(head: int, block: int, cols: list[np.ndarray]) -> pa.RecordBatch:
            lists = [pa.ListArray.from_arrays(pa.array([0, len(c)], pa.int32()), pa.array(c, t)) for c, t in ((cols[2], pa.int64()), (cols[3], pa.int32()), (cols[1], load.array))]
            return pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, load.value[2]), pa.array([head]), pa.array([block], pa.int32()), *lists], names)

        def work(cols: list[np.ndarray], last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal hot, rest
            head, payload, tid, size = cols
            if not len(head):
                return
            cuts = np.flatnonzero(np.r_[True, head[1:] != head[:-1]])
            ends = np.r_[cuts[1:], len(head)]
            if not last:  # the last run may go on in the next batch
                keep = cuts[-1]
                if hot is not None and head[keep] == hot[0] or len(head) - keep > HOT:
                    h, block = (int(head[keep]), hot[1] if hot is not None and head[keep] == hot[0] else 0)
                    while len(head) - keep > HOT:
                        yield give(h, block, [c[keep : keep + HOT] for c in cols])
                        block, keep = block + 1, keep + HOT
                    after = (h, block)
                else:
                    after = None
                rest, cuts, ends = [c[keep:] for c in cols], cuts[:-1], ends[:-1]
            else:
                after, rest = None, [c[:0] for c in cols]
            small = []
            for lo, hi in zip(cuts[ends - cuts > 1], ends[ends - cuts > 1], strict=True):
                if hi - lo > HOT or (hot is not None and head[lo] == hot[0]):
                    block = hot[1] if hot is not None and head[lo] == hot[0] else 0
                    for at in range(lo, hi, HOT):
                        yield give(int(head[lo]), block, [c[at : min(at + HOT, hi)] for c in cols])
                        block += 1
                else:
                    small.append(np.arange(lo, hi))
            if hot is not None and len(cuts) and head[0] == hot[0] and ends[0] - cuts[0] == 1:
                yield give(int(head[0]), hot[1], [c[:1] for c in cols])
            hot = after
            if small:
                i = np.concatenate(small)
                judge, k = load.ready(payload, i), 1
                while len(i):  # leaves k places apart in one neighbourhood
                    i = i[i + k < len(head)]
                    i = i[head[i + k] == head[i]]
                    out = pairs(tid, size, judge, i, i + k)
                    if out is not None:
                        yield out
                    k += 1

        for b in batches:
            yield from work([np.concatenate((r, c)) for r, c in zip(rest, (b.column(j).to_numpy(zero_copy_only=False) for j in range(4)), strict=True)], False)
        yield from work(rest, True)

    return run, pairs


def _met(leaves: DataFrame, threshold: float, load: _Texts | _Tails) -> DataFrame:
    """(x, y, value) of the neighbours in the trees of leaves (head, payload, tid, size); a pair once a tree in which it meets.

    The blocks of a hot neighbourhood are compared with each other by one task a pair of blocks.
    """
    run, pairs = _neighbours(threshold, load)
    found = written(leaves.mapInArrow(run, _schema(load)))
    near = found.where("head is null").select("x", "y", load.value[0])

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for own, *cols in zip(*(b.column(k).to_pylist() for k in range(7)), strict=True):
                p, q = ([np.array(c, t) for c, t in zip(side, (np.int64, np.int32, load.array.to_pandas_dtype()), strict=True)] for side in (cols[:3], cols[3:]))
                tid, size, payload = (np.concatenate(x) for x in zip(p, q, strict=True))
                n, m = len(p[0]), len(q[0])
                judge = load.ready(payload, np.arange(n if own else n + m))
                for r in range(n):
                    j = np.arange(r + 1, n) if own else n + np.arange(m)
                    out = pairs(tid, size, judge, np.full(len(j), r), j)
                    if out is not None:
                        yield out.select(["x", "y", load.value[0]])

    hot = found.where("head is not null").select("head", "block", "tids", "sizes", "loads")
    other = hot.select("head", F.col("block").alias("b"), *[F.col(c).alias(f"o{c}") for c in ("tids", "sizes", "loads")])
    tasks = hot.join(other, "head").where("block <= b").select((F.col("block") == F.col("b")).alias("own"), "tids", "sizes", "loads", "otids", "osizes", "oloads")
    return near.union(tasks.repartition(F.rand(7)).mapInArrow(across, f"x long, y long, {load.value[0]} {load.value[1]}"))


def candidates(leaves: DataFrame, threshold: float) -> DataFrame:
    """(x, y, deeper): distinct pairs of sets that are neighbours in a tree, with the most levels they share below the shallowest depth.

    Leaves (head, tail, tid, size) of a common prefix meet in one partition, in the order of their signatures.
    """
    near = _met(leaves.repartition("head").sortWithinPartitions("head", "tail").select("head", "tail", "tid", "size"), threshold, _Tails())
    return near.groupBy("x", "y").agg(F.max("deeper").alias("deeper"))


def similar_texts(texts: DataFrame, width: int = 6, threshold: float = 0.7, recall: float = 0.9999, seed: int = 20) -> DataFrame:
    """(x, y, similarity): ids of all pairs of distinct texts (tid, text) whose piece sets have at least that Jaccard similarity.

    Sketch forest: the minhash signatures of many independent trees are sorted, and neighbours of a common prefix are
    candidates where their sizes allow the threshold. A pair exactly at the threshold meets in some tree with probability
    `recall`, a more similar one more likely. Trees are grown a few at a time: leaves carry their texts, so that a task
    verifies the neighbours it meets, on the exact sets, and what stays of a round are its pairs. Signatures aren't kept.
    """
    spark = texts.sparkSession
    n = texts.count()
    depth, trees = forest_shape(n, threshold, recall)
    before, found = set(tables_of(spark)), None
    step = max(2, LEAVES // max(n, 1))
    for first in range(0, trees, step):
        last = min(trees, first + step)
        leaves = texts.select("tid", "text").mapInArrow(_leaves(width, depth, trees, first, last, seed), "head long, text string, tid long, size int").where("size > 0")
        met = _met(leaves.repartition("head").sortWithinPartitions("head"), threshold, _Texts(width, threshold))
        met = (met if found is None else found.union(met)).groupBy("x", "y").agg(F.max("similarity").alias("similarity"))
        old = set(tables_of(spark)) - before
        found = written(met)
        drop_tables(spark, old)
        release(spark)
    return found


def similar_records(rows: DataFrame, id_col: str, text_col: str, width: int = 6, threshold: float = 0.7, recall: float = 0.9999, seed: int = 20) -> DataFrame:
    """(id_a, id_b, similarity), id_a < id_b: every pair of records with similar piece sets.

    Texts count without outer white space. A record with a null text or one shorter than `width` has an empty set and is in no
    pair. Records that repeat a text are compared once; their pairs are expanded at the end. Ids must be unique.
    """
    r = rows.select(F.col(id_col).alias("id"), stripped(text_col).alias("text")).where(F.length("text") >= width)
    # the place in a sorted partition is written, so that it doesn't change when a task runs again
    placed = r.repartition("text").sortWithinPartitions("text", "id").withColumn("at", F.monotonically_increasing_id()).withColumn("tid", F.min("at").over(Window.partitionBy("text")))
    members = written(placed.select("id", "tid", F.when(F.col("at") == F.col("tid"), F.col("text")).alias("text")))  # a text stands in its first row
    release(r.sparkSession)
    pairs = similar_texts(members.where("text is not null").select("tid", "text"), width, threshold, recall, seed)
    a, b = members.select(F.col("id").alias("p"), F.col("tid").alias("x")), members.select(F.col("id").alias("q"), F.col("tid").alias("y"))
    across = pairs.join(a, "x").join(b, "y").select(F.least("p", "q").alias("id_a"), F.greatest("p", "q").alias("id_b"), "similarity")
    twice = members.select("id", "tid").join(members.where("text is null").select("tid").distinct(), "tid", "left_semi")
    same = twice.select(F.col("id").alias("id_a"), "tid").join(twice.select(F.col("id").alias("id_b"), "tid"), "tid").where("id_a < id_b").select("id_a", "id_b", F.lit(1.0).alias("similarity"))
    return across.union(same)
