"""Problem 3: occurrences and records of every distinct term."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crucible.runtime import written

#: The terms of a SMILES, from left to right: a bracket with its content, Br, Cl, % with two digits, any other single character that isn't white space.
SMILES_TERMS = r"\[[^\]]*\]|Br|Cl|%[0-9][0-9]|\S"
#: Identifiers a block of counts covers.
RANGE = 1 << 16
#: Distinct terms that a task holds before it gives out what it has.
FLUSH = 200_000


def block_counts(texts: DataFrame, col: str, pattern: str) -> DataFrame:
    """(term, occurrences, records): counts of blocks of texts, a row a distinct term of a block; a block ends at FLUSH distinct terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, occurrences, records = re.compile(pattern).findall, Counter(), Counter()

        def out() -> pa.RecordBatch:
            keys = list(occurrences)
            return pa.RecordBatch.from_pydict({"term": pa.array(keys, pa.string()), "occurrences": pa.array([occurrences[k] for k in keys], pa.int64()), "records": pa.array([records[k] for k in keys], pa.int64())})

        for b in batches:
            for s in b.column(0).to_pylist():
                if s is None:
                    continue
                own = find(s)
                occurrences.update(own)
                records.update(set(own))
                if len(occurrences) > FLUSH:
                    yield out()
                    occurrences.clear(), records.clear()
        yield out()

    return texts.select(col).mapInArrow(run, "term string, occurrences long, records long")


def dictionary(counted: DataFrame) -> DataFrame:
    """(id, term): every distinct term with its place in the sorted order, from 0 without gaps."""
    terms = counted.select("term").distinct()
    placed = written(terms.repartitionByRange("term").sortWithinPartitions("term").withColumn("at", F.monotonically_increasing_id()))
    placed = placed.withColumn("part", F.shiftright("at", 33))
    sizes = placed.groupBy("part").count().orderBy("part").collect()  # one row a partition
    start, offsets = 0, []
    for p, n in sizes:
        offsets.append((p, start))
        start += n
    first = placed.sparkSession.createDataFrame(offsets, "part long, first long")
    return placed.join(F.broadcast(first), "part").select((F.col("first") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1))).alias("id"), "term")


def range_arrays(encoded: DataFrame) -> DataFrame:
    """(range, occurrences, records): the counts of (id, occurrences, records) rows as two arrays a range of RANGE identifiers.

    The rows of a range meet in one partition, sorted, so a task holds one pair of arrays at a time. A range meets at most
    RANGE rows a block of texts, however often a term occurs.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sums = -1, None

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"range": pa.array([now], pa.int64()), "occurrences": pa.array([sums[0]], pa.list_(pa.int64())), "records": pa.array([sums[1]], pa.list_(pa.int64()))})

        for b in batches:
            ids, o, r = (b.column(i).to_numpy() for i in range(3))
            ranges = ids // RANGE
            cuts = np.flatnonzero(np.r_[True, ranges[1:] != ranges[:-1]]) if len(ids) else np.zeros(0, int)
            for lo, hi in zip(cuts, np.r_[cuts[1:], len(ids)], strict=True):
                if ranges[lo] != now:
                    if sums is not None:
                        yield out()
                    now, sums = int(ranges[lo]), np.zeros((2, RANGE), np.int64)
                np.add.at(sums[0], ids[lo:hi] % RANGE, o[lo:hi])
                np.add.at(sums[1], ids[lo:hi] % RANGE, r[lo:hi])
        if sums is not None:
            yield out()

    part = F.floor(F.col("id") / RANGE)
    return encoded.repartition(part).sortWithinPartitions("id").mapInArrow(run, "range long, occurrences array<long>, records array<long>")


def term_frequencies(rows: DataFrame, text_col: str, pattern: str = SMILES_TERMS, min_records: int = 3, max_share: float = 0.8) -> DataFrame:
    """(term, occurrences, records, mark) of every distinct term; mark is 'rare' below min_records records, 'common' above max_share of all, else null.

    All rows given count as records, also those whose text is null or has no term. No rows: no terms. One plan at every size:
    blocks of texts are counted by term, the distinct terms make the dictionary, the blocks' rows are encoded by a join and
    summed into arrays by identifier range.
    """
    texts = rows.select(F.col(text_col).alias("text"))
    n = texts.count()
    counted = written(block_counts(texts, "text", pattern))
    words = written(dictionary(counted))
    arrays = range_arrays(counted.join(words, "term").select("id", "occurrences", "records"))
    cells = arrays.select("range", F.posexplode(F.arrays_zip("occurrences", "records")).alias("at", "c")).where("c.occurrences > 0")
    total = cells.select((F.col("range") * RANGE + F.col("at")).alias("id"), "c.occurrences", "c.records")
    mark = F.when(F.col("records") < min_records, "rare").when(F.col("records") > F.lit(max_share) * F.lit(n), "common")
    return words.join(total, "id").select("term", "occurrences", "records", mark.alias("mark"))
