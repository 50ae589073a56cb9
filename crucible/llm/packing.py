"""Problem 7: fixed-capacity containers filled with items of varying size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crucible.llm.tokens import VOCABULARY, encode_texts
from crucible.runtime import cut, written


class SumIndex:
    """Which sizes, and sums of two sizes, are available under the counts left, kept up as items are taken.

    singles[s] is the number of items of size s, pairs[t] the number of pairs of sizes (a <= b) that sum to t and are both
    there, twice where a = b; a triple of sum t is a size s with pairs[t - s], checked against the counts when it is taken.
    """

    def __init__(self, available: np.ndarray):
        self.singles = available.astype(np.int64).copy()
        self.singles[0] = 0
        n = len(self.singles)
        self.pairs = np.zeros(2 * n, np.int64)
        self.sizes = np.flatnonzero(self.singles)
        for k, s in enumerate(self.sizes):
            self.pairs[s + self.sizes[k + 1 :]] += 1
            if self.singles[s] > 1:
                self.pairs[2 * s] += 1

    def take(self, s: int, times: int = 1) -> None:
        left = self.singles[s] - times
        if self.singles[s] > 1 >= left:
            self.pairs[2 * s] -= 1
        self.singles[s] = left
        if not left:
            self.sizes = self.sizes[self.sizes != s]
            self.pairs[s + self.sizes] -= 1

    def pair(self, total: int) -> list[int]:
        """Two available sizes of that sum, the nearest to each other; empty where there are none."""
        if total < 2 or not self.pairs[total]:
            return []
        own = self.sizes[(self.sizes * 2 <= total) & (self.sizes < total)]
        other = total - own
        ok = other < len(self.singles)
        ok[ok] = (self.singles[other[ok]] > 0) & ((other[ok] != own[ok]) | (self.singles[own[ok]] > 1))
        return [int(total - own[ok][-1]), int(own[ok][-1])] if ok.any() else []

    def exact(self, gap: int) -> list[int]:
        """One, two or three available sizes that sum to the gap; the largest first size is tried first."""
        if self.singles[gap]:
            return [gap]
        two = self.pair(gap)
        if two:
            return two
        own = self.sizes[self.sizes < gap]
        for s in own[self.pairs[gap - own] > 0][::-1]:
            s = int(s)
            rest = self.pair(gap - s)
            if rest and rest.count(s) < self.singles[s]:
                return [s, *rest]
        return []


def plan(available: np.ndarray) -> list[tuple[int, list[int]]]:
    """(number of containers, sizes in each) for available[s] items of size s; the capacity is the last index.

    A container starts with the largest size left and takes the largest that fits until three items or fewer can fill the
    gap; then the index of single, pair and triple sums is asked for an exact complement, and only where none exists the best
    fitting size is taken. A pattern is used as often as its counts allow, so the work follows the number of distinct sizes,
    not of items.
    """
    index = SumIndex(available)
    have, capacity, out = index.singles, len(available) - 1, []
    while len(index.sizes):
        left = index.sizes
        largest, least = int(left[-1]), int(left[0])
        typical = max(1, int((left * have[left]).sum() // have[left].sum()))
        took, gap = [largest], capacity - largest
        index.take(largest)
        while gap >= least:
            if gap <= 4 * typical or gap <= 3 * largest:
                exact = index.exact(gap)
                if exact:
                    for s in exact:
                        index.take(s)
                    took += exact
                    break
            at = int(np.searchsorted(index.sizes, gap, side="right"))
            if not at:
                break
            s = int(index.sizes[at - 1])
            index.take(s)
            took.append(s)
            gap -= s
        sizes, need = np.unique(took, return_counts=True)
        more = int((have[sizes] // need).min())
        for s, k in zip(sizes.tolist(), need.tolist(), strict=True):
            if more:
                index.take(s, k * more)
        out.append((1 + more, took))
    return out


def pack(items: DataFrame, id_col: str = "doc_id", size_col: str = "tokens", capacity: int = 2048) -> DataFrame:
    """(container, id, piece, tokens): every item with a size above 0 in a container, whole unless it exceeds the capacity.

    An item above the capacity fills containers of its own with its first pieces; the last piece, if any, is packed like an
    item. Null and zero sizes are left out. Only the counts by size, at most `capacity` rows, reach the driver; the plan gives
    ranges of ranks within a size to slots of patterns, and every item finds its container by its rank.
    """
    sized = items.select(F.col(id_col).alias("id"), F.col(size_col).cast("long").alias("n")).where("n > 0")
    whole = F.floor(F.col("n") / capacity)
    tail = F.col("n") % capacity
    pieces = sized.select("id", "n", F.explode(F.sequence(F.lit(0), (whole + (tail > 0).cast("long") - 1).cast("int"))).alias("piece"))
    pieces = pieces.select("id", "piece", F.least(F.lit(capacity), F.col("n") - F.col("piece").cast("long") * capacity).cast("int").alias("tokens"))
    # the place within a sorted partition is part of the written rows, so ranks don't change when a task is run again
    placed = cut(pieces.repartitionByRange("tokens", "id", "piece").sortWithinPartitions("tokens", "id", "piece").withColumn("at", F.monotonically_increasing_id()))
    runs = placed.groupBy(F.shiftright("at", 33).alias("part"), "tokens").agg(F.count("*").alias("n"), F.min("at").alias("first")).orderBy("part", "tokens").collect()
    have, start = np.zeros(capacity + 1, np.int64), []
    for part, size, n, first in runs:  # partitions are ranges of sizes: at most one row a partition and size
        start.append((part, size, first, int(have[size])))
        have[size] += n
    spark = items.sparkSession
    slots, used, base = [], np.zeros(capacity + 1, np.int64), 0
    for times, took in plan(have):
        for size in took:
            slots.append((size, int(used[size]), base))
            used[size] += times
        base += times
    # at most a slot a place of a pattern, and every pattern but the last uses a size up: bounded by the capacity, not by the items
    by_size = np.array(sorted(slots), np.int64).reshape(-1, 3)
    start_df = spark.createDataFrame(start, "part long, tokens int, first long, before long")
    ranked = placed.withColumn("part", F.shiftright("at", 33)).join(F.broadcast(start_df), ["part", "tokens"]).select("id", "piece", "tokens", (F.col("at") - F.col("first") + F.col("before")).alias("rank"))
    sent = spark.sparkContext.broadcast(by_size)

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size, low, first = sent.value.T
        span = 1 << 40  # ranks of a size; slots in the order of size and rank are found by one search
        for b in batches:
            tokens, rank = b.column(2).to_numpy().astype(np.int64), b.column(3).to_numpy()
            at = np.searchsorted(size * span + low, tokens * span + rank, side="right") - 1
            yield pa.RecordBatch.from_arrays([pa.array(first[at] + rank - low[at]), b.column(0), b.column(1), b.column(2)], ["container", "id", "piece", "tokens"])

    kind = dict(items.dtypes)[id_col]
    return ranked.mapInArrow(fill, f"container long, id {kind}, piece int, tokens int").withColumnRenamed("id", id_col)


def pack_texts(rows: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048, vocabulary: str = VOCABULARY) -> DataFrame:
    """The texts of a table in containers of that many tokens; null and empty texts take no room and are left out."""
    # written, as laying items out by size reads them twice
    return pack(written(encode_texts(rows, id_col, text_col, vocabulary, out="tokens")), id_col, "tokens", capacity)
