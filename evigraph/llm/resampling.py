"""Importance resampling towards a target distribution over hashed n-gram features.

A feature is a run of one to three words; its bucket is the CRC-32 of its UTF-8 bytes modulo a
number of buckets. The CRC of every word is computed once. CRCs are linear over GF(2): that of a
concatenation is the left part's CRC moved by the right part's length, which is a 32 x 32 bit
matrix for each length, XOR the right part's CRC. So n-grams get their CRCs from their words'
CRCs and lengths, and no n-gram is ever a string.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evigraph.llm import spans
from evigraph.llm.shared import Scratch

#: Bytes that end words: ASCII other than letters and digits.
SEPARATORS = [b for b in range(128) if not chr(b).isalnum()]
BUCKETS = 10_000
LONGEST = 3
SEED = "42"
LEAST_WORDS, DRAWN_PERCENT = 20, 5
#: Rows of one range of the ranking: USUAL_ROWS while there are at most MANY_RANGES of these, then up to MOST_ROWS.
USUAL_ROWS, MANY_RANGES, MOST_ROWS = 10_000, 512, 2_000_000

_POLYNOMIAL = 0xEDB88320  # fixed value: the reflected CRC-32 polynomial
#: Lengths with a table of their own; longer ones are made of powers of two.
_SMALL = 64
#: Bytes beyond which a word's CRC is left to zlib.
_LONG_WORD = 64

_LOWER = spans.table(SEPARATORS)
_BREAK = _LOWER == spans.SPACE


def _byte_table() -> np.ndarray:
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, (c >> 1) ^ np.uint32(_POLYNOMIAL), c >> 1)
    return c


_BYTE = _byte_table()


def _apply(matrix: np.ndarray, crc: np.ndarray) -> np.ndarray:
    """A matrix, held as the images of all values of each of the four bytes, times CRCs."""
    return matrix[0][crc & 255] ^ matrix[1][crc >> 8 & 255] ^ matrix[2][crc >> 16 & 255] ^ matrix[3][crc >> 24]


def _length_matrices() -> np.ndarray:
    """[n]: what n zero bytes make of a CRC, as a matrix."""
    one = np.arange(256, dtype=np.uint32)
    out = [np.stack([one << np.uint32(8 * k) for k in range(4)])]
    for _ in range(_SMALL):
        out.append(_BYTE[out[-1] & 255] ^ out[-1] >> 8)
    return np.stack(out)


_BY_LENGTH = _length_matrices()
_powers = [_BY_LENGTH[_SMALL]]  # matrices of _SMALL * 2 ** k bytes


def shift(crc: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """CRCs moved by so many bytes each: what zero bits appended to the message do to the CRC's linear part."""
    low = lengths % _SMALL
    out = _BY_LENGTH[low, 0, crc & 255] ^ _BY_LENGTH[low, 1, crc >> 8 & 255] ^ _BY_LENGTH[low, 2, crc >> 16 & 255] ^ _BY_LENGTH[low, 3, crc >> 24]
    high, k = lengths // _SMALL, 0
    while high.any():
        while len(_powers) <= k:
            _powers.append(_apply(_powers[-1], _powers[-1]))
        odd = np.flatnonzero(high & 1)
        out[odd] = _apply(_powers[k], out[odd])
        high, k = high >> 1, k + 1
    return out


def combine(left: np.ndarray, right: np.ndarray, right_lengths: np.ndarray) -> np.ndarray:
    """CRC-32 of concatenations, from the CRCs of both parts and the right part's length in bytes."""
    return shift(left, right_lengths) ^ right


def word_crcs(low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """CRC-32 of stretches of bytes, a byte of all of them at a time, the longest first."""
    lens = ends - starts
    out = np.empty(len(starts), np.uint32)
    order = np.argsort(-np.minimum(lens, _LONG_WORD + 1), kind="stable")
    n_long = int((lens > _LONG_WORD).sum())
    for i in order[:n_long]:
        out[i] = zlib.crc32(low[starts[i] : ends[i]])
    order = order[n_long:]
    at, left = starts[order], -lens[order]
    crc = np.full(len(order), 0xFFFFFFFF, np.uint32)
    for j in range(_LONG_WORD):
        n = int(np.searchsorted(left, -j, "left"))  # words of more than j bytes
        if n == 0:
            break
        part = crc[:n]
        crc[:n] = _BYTE[(part ^ low[at[:n] + j]) & 255] ^ part >> 8
    out[order] = crc ^ np.uint32(0xFFFFFFFF)
    return out


def features(column: pa.Array, longest: int = LONGEST) -> Iterator[tuple[int, np.ndarray, list[tuple[np.ndarray, np.ndarray]]]]:
    """Slices of texts: (first row, row of each word, for each n the rows and CRCs of n-grams that end in the slice)."""
    space = np.array([zlib.crc32(b" ")], np.uint32)
    last_row, held = -1, [np.empty(0, np.uint32)] * longest  # per n: CRC of the n-gram that ends at the last word
    for lo, data, cuts in spans.slices(column, _BREAK):
        low = _LOWER[data]
        starts, ends = spans.words(low, cuts)
        rows = lo + spans.rows_of(cuts, starts)
        if not len(rows):
            continue
        lens, own = ends - starts, word_crcs(low, starts, ends)
        spaced = shift(np.repeat(space, len(own)), lens) ^ own  # of a space and the word
        before = np.r_[last_row, rows[:-1]]
        out, grams, live = [(rows, own)], own, np.ones(len(rows), bool)
        fresh = [own[-1:]]
        for n in range(1, longest):
            # the n-gram that ends one word earlier; for the first word of a slice it was kept
            carried = held[n - 1] if len(held[n - 1]) and rows[0] == last_row else np.zeros(1, np.uint32)
            has = np.r_[len(held[n - 1]) > 0 and rows[0] == last_row, live[:-1]] & (before == rows)
            grams = combine(np.concatenate([carried, grams[:-1]]), spaced, lens + 1)
            live = has
            out.append((rows[live], grams[live]))
            fresh.append(grams[-1:] if live[-1] else np.empty(0, np.uint32))
        last_row, held = int(rows[-1]), fresh
        yield lo, rows, out


def count_features(texts: DataFrame, text: str, buckets: int = BUCKETS, longest: int = LONGEST) -> DataFrame:
    """(bucket, n): how many features of all whole texts fall into each bucket that has any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, _, grams in features(batch.column(0), longest):
                for _, crc in grams:
                    total += np.bincount(crc % np.uint32(buckets), minlength=buckets)
        full = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(full, pa.int64()), pa.array(total[full])], names=["bucket", "n"])

    return texts.select(F.col(text).cast("string").alias("text")).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def fit_gains(docs: DataFrame, text: str, target: DataFrame, target_text: str, buckets: int = BUCKETS, longest: int = LONGEST) -> np.ndarray:
    """What one feature of each bucket adds to a weight: floor(1000 ln) of the ratio of its smoothed shares in target and docs.

    Counts cover all rows of both tables; only one number a bucket (BUCKETS of them) comes to the driver.
    """
    sides = []
    for frame, column in ((docs, text), (target, target_text)):
        n = np.zeros(buckets, np.int64)
        for r in count_features(frame, column, buckets, longest).collect():
            n[r["bucket"]] = r["n"]
        sides.append(n)
    (s, t), (all_s, all_t) = sides, (int(x.sum()) for x in sides)
    return np.array([math.floor(1000 * math.log(float(b + 1) * (all_s + buckets) / (float(a + 1) * (all_t + buckets)))) for a, b in zip(s.tolist(), t.tolist())], np.int64)


def weigh(docs: DataFrame, key: str, text: str, gains: np.ndarray, longest: int = LONGEST) -> DataFrame:
    """Columns key, n_words, n_features, weight for every row of docs."""
    buckets = len(gains)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, n_features, weight = (np.zeros(batch.num_rows, np.int64) for _ in range(3))
            for _, rows, grams in features(batch.column(1), longest):
                np.add.at(n_words, *_sums(rows, None))
                for owner, crc in grams:
                    if len(owner):
                        np.add.at(n_features, *_sums(owner, None))
                        np.add.at(weight, *_sums(owner, gains[crc % np.uint32(buckets)]))
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, (n_words, n_features, weight))], names=["key", "n_words", "n_features", "weight"])

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, f"key {kind}, n_words long, n_features long, weight long")


def _sums(rows: np.ndarray, values: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """(distinct rows, their sums) of ascending rows; without values how often each comes."""
    first = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
    return rows[first], np.add.reduceat(values, first) if values is not None else np.diff(np.r_[first, len(rows)])


def gumbel(key: Column, seed: str = SEED) -> Column:
    """A document's own draw of floor(1000 Gumbel): it depends on its key and the seed alone. A null key is the empty string."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0))))


def ranked(scratch: Scratch, rows: DataFrame, order: Sequence[Column], out: str) -> DataFrame:
    """rows with their places, from 1, in a total order over all of them, without one task that holds all.

    Rows are dealt by range and numbered in each range; ranges are shifted by the rows before them.
    rows must be a written table: its own file order tells equal rows apart.
    """
    placed = rows.withColumn("_tie", F.monotonically_increasing_id())
    n = rows.count()
    ranges = max(1, min(-(-n // USUAL_ROWS), MANY_RANGES), -(-n // MOST_ROWS))
    sorted_rows = placed.repartitionByRange(ranges, *order, "_tie").sortWithinPartitions(*order, "_tie").withColumn("_place", F.monotonically_increasing_id()).drop("_tie")
    written = scratch.save(sorted_rows, f"by-{out}").withColumn("_range", F.shiftright("_place", 33))
    first = written.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    # one row a range
    shifts = {r["_range"]: r["_n"] for r in first.collect()}
    base, total = {}, 0
    for k in sorted(shifts):
        base[k], total = total, total + shifts[k]
    starts = rows.sparkSession.createDataFrame([(k, v) for k, v in base.items()], "_range long, _base long")
    own = F.col("_place") - F.shiftleft(F.col("_range"), 33)
    return written.join(F.broadcast(starts), "_range").withColumn(out, own + F.col("_base") + 1).drop("_place", "_range", "_base")


def resample(docs: DataFrame, key: str, text: str, target: DataFrame, target_text: str, percent: int = DRAWN_PERCENT, least_words: int = LEAST_WORDS, buckets: int = BUCKETS, seed: str = SEED) -> DataFrame:
    """Draw documents that read like the texts of target; one row per row of docs.

    Columns: key, n_words, n_features, weight (sum of the gains of its features), score (weight
    plus the document's own Gumbel draw), rank: 1, 2, 3 ... for the drawn, by falling score, then
    rising key; null for the rest. Drawn are floor(percent / 100) of the documents of at least
    ``least_words`` words. A null text has no features and weight 0. A null key draws as the empty
    string and comes first among ties. Rows that repeat a key each count and get ranks of their
    own. An empty table gives no rows; an empty target smooths to equal shares. Only the named
    columns are read.
    """
    scratch = Scratch(docs.sparkSession, "resampling")
    gains = fit_gains(docs, text, target, target_text, buckets)
    weighed = scratch.save(weigh(docs, key, text, gains).withColumn("score", F.col("weight") + gumbel(F.col("key"), seed)), "weighed")
    able = F.col("n_words") >= least_words
    n = weighed.filter(able).count()
    out = ranked(scratch, weighed, [(~able).asc(), F.col("score").desc(), F.col("key").asc_nulls_first()], "place")
    out = out.withColumn("rank", F.when(able & (F.col("place") <= percent * n // 100), F.col("place"))).drop("place")
    scratch.drop("weighed")
    return out.withColumnRenamed("key", key)
