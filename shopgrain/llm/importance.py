"""Resampling of documents towards the distribution of a target corpus.

Features of a text are its runs of 1 to ``longest`` consecutive words, repeats counted; a
feature falls into one of ``buckets`` buckets by the CRC-32 of its bytes. The counts of
both corpora per bucket give every bucket a gain, the scaled log ratio of its smoothed
shares, and the gains are one array of ``buckets`` numbers that every task holds: the
weight of a text is the floored mean of the gains of its features, looked up in that array.
The score adds Gumbel noise that depends on the key only, so the texts with the highest
scores are a draw without replacement by weight, and the same in every run.

The draw needs the k-th score, not a sort of all. It is found by a quickselect over the
written scores: random pivot keys are drawn from what is still open, one aggregation counts
exactly how many keys are below, equal to and above each, and the range between two pivots
that holds the k-th goes on. Only the winners are then sorted, by ranges, and ranked by the
number of winners in the ranges before. Keys are composite (score falling, key rising, text
hash, row number of the written table) and therefore all different: rows of one key or one
score are drawn one by one, and no group of ties ever meets in one task.

Nulls: a null text has no words (weight 0, not drawn if ``min_words`` is above 0); a null key
gets noise as an empty one and stands after all others in ties. Repeated rows are rows of
their own. An empty table gives an empty result, an empty target flat shares. Extra columns
of the documents are left out, so their names cannot clash.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from shopgrain.session import stored

# Bytes of words stay, A-Z become a-z, all other ASCII parts words.
_FOLD = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256)
)
OUT = ("n_features", "weight", "score", "rank")
_ORDER = ("down", "no_key", "key", "mark", "row")


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(_FOLD).split() if text else []


class Buckets:
    """Bucket numbers of the features of texts; remembers frequent words up to a bound."""

    def __init__(self, buckets: int, longest: int, remembered: int = 1 << 16) -> None:
        self.buckets, self.longest, self.remembered = buckets, longest, remembered
        self.known: dict[bytes, int] = {}

    def _of(self, feature: bytes) -> int:
        if len(self.known) >= self.remembered:
            self.known.clear()
        found = self.known[feature] = zlib.crc32(feature) % self.buckets
        return found

    def of(self, words: list[bytes]) -> np.ndarray:
        get, make = self.known.get, self._of
        found = [b if (b := get(w)) is not None else make(w) for w in words]
        for size in range(2, self.longest + 1):
            found += [zlib.crc32(b" ".join(words[i : i + size])) % self.buckets for i in range(len(words) - size + 1)]
        return np.array(found, np.int64)


def bucket_counts(docs: DataFrame, text: str = "text", buckets: int = 10_000, longest: int = 1) -> np.ndarray:
    """Features per bucket over all texts. Every task adds up its own array; what comes
    back is one number per bucket."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, total = Buckets(buckets, longest), np.zeros(buckets, np.int64)
        for batch in batches:
            for value in batch.column(0):
                total += np.bincount(found.of(words_of(value.as_py())), minlength=buckets)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], names=["bucket", "n"])

    counted = docs.select(F.col(text).cast("binary")).mapInArrow(count, "bucket long, n long")
    total = np.zeros(buckets, np.int64)
    for r in counted.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        total[r["bucket"]] = r["n"]
    return total


def gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln(target share / raw share)) of every bucket, one added to each count."""
    n = len(raw)
    all_raw, all_target = float(raw.sum() + n), float(target.sum() + n)
    ratio = [(float(t + 1) * all_raw) / (float(s + 1) * all_target) for s, t in zip(raw.tolist(), target.tolist())]
    return np.array([math.floor(1000 * math.log(r)) for r in ratio], np.int64)


def noise(key: str, seed: str) -> int:
    """Scaled Gumbel noise of a key, the same in every run."""
    h = int(hashlib.sha256(f"{seed}:{key}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scored(
    docs: DataFrame, gain: np.ndarray, key: str = "doc_id", text: str = "text", longest: int = 1, seed: str = "2024"
) -> DataFrame:
    """key, n_words, n_features, weight, score and mark (a hash of the text) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(gain)  # one number per bucket
    names = ("n_words", "n_features", "weight", "score")
    plain = docs.select(
        F.col(key).alias("key"),
        F.xxhash64(text).alias("mark"),
        F.coalesce(F.col(key).cast("string"), F.lit("")).alias("name"),
        F.col(text).cast("binary").alias("text"),
    )
    kept = plain.select("key", "mark")
    schema = StructType([*kept.schema.fields, *(StructField(n, LongType()) for n in names)])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = Buckets(len(shared.value), longest)
        for batch in batches:
            rows = []
            for name, value in zip(batch.column(2).to_pylist(), batch.column(3)):
                words = words_of(value.as_py())
                places = found.of(words)
                weight = int(shared.value[places].sum()) // len(places) if len(places) else 0
                rows.append((len(words), len(places), weight, weight + noise(name, seed)))
            made = [pa.array(c, pa.int64()) for c in (zip(*rows) if rows else [()] * 4)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *made], names=schema.names)

    return plain.mapInArrow(score, schema)


def _literal(rows: DataFrame, order: tuple[str, ...], row: Row) -> Column:
    return F.struct(*(F.lit(row[c]).cast(rows.schema[c].dataType).alias(c) for c in order))


def kth(rows: DataFrame, order: tuple[str, ...], k: int, pivots: int = 32) -> Row:
    """The k-th row (from 1) by ``order``, of which every row has another value.

    ``rows`` is a written table. A turn draws ``pivots`` of the rows that are still open, by a
    hash that differs from turn to turn, and counts the rows below and at each of them; so
    the open range shrinks by about that factor, and a range of fewer rows is the last.
    """
    key = F.struct(*order)
    low = high = None
    turn = 0
    while True:
        open_ = rows
        for bound, side in ((low, "low"), (high, "high")):
            if bound is not None:
                at, first = _literal(rows, order, bound), F.lit(bound[order[0]])
                # The first column alone as well: that one reaches the scan.
                open_ = open_.where((key > at) & (F.col(order[0]) >= first) if side == "low" else (key < at) & (F.col(order[0]) <= first))
        dice = F.xxhash64(*order, F.lit(turn))
        drawn = open_.select(*order).orderBy(dice).limit(pivots).orderBy(*order).collect()
        marks = [_literal(rows, order, p) for p in drawn]
        counts = open_.agg(
            *(F.count_if(key < m).alias(f"below{i}") for i, m in enumerate(marks)),
            *(F.count_if(key == m).alias(f"equal{i}") for i, m in enumerate(marks)),
        ).first()
        passed = 0
        for i, pivot in enumerate(drawn):
            below, equal = counts[f"below{i}"], counts[f"equal{i}"]
            if below < k <= below + equal:
                return pivot
            if below >= k:
                high = pivot
                break
            low, passed = pivot, below + equal
        k -= passed
        turn += 1


def ranked(rows: DataFrame, order: tuple[str, ...]) -> DataFrame:
    """``rows`` with ``rank`` (1, 2, ... by ``order``): sorted by ranges, each counted once."""
    schema = StructType([*rows.schema.fields, StructField("part", IntegerType()), StructField("at", LongType())])

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at = TaskContext.get().partitionId(), 0
        for batch in batches:
            n = batch.num_rows
            made = [pa.array(np.full(n, part, np.int32)), pa.array(np.arange(at + 1, at + n + 1))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], names=schema.names)
            at += n

    placed = stored(rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(number, schema), "winners")
    # One row per shuffle partition, whatever the number of winners.
    sizes = sorted(placed.groupBy("part").agg(F.count("*").alias("n")).collect())
    starts, before = [], 0
    for r in sizes:
        starts.append((r["part"], before))
        before += r["n"]
    firsts = rows.sparkSession.createDataFrame(starts, "part int, before long")
    return placed.join(F.broadcast(firsts), "part").withColumn("rank", F.col("before") + F.col("at")).drop("part", "at", "before")


def resample(
    docs: DataFrame,
    target: DataFrame,
    percent: int = 10,
    min_words: int = 20,
    buckets: int = 10_000,
    longest: int = 1,
    seed: str = "2024",
    key: str = "doc_id",
    text: str = "text",
    target_text: str = "text",
    pivots: int = 32,
) -> DataFrame:
    """key, n_features, weight, score and rank of every row of ``docs``.

    ``percent`` of the rows of at least ``min_words`` words (rounded down) have a rank, the
    others null.
    """
    gain = gains(bucket_counts(docs, text, buckets, longest), bucket_counts(target, target_text, buckets, longest))
    found = scored(docs, gain, key, text, longest, seed).select(
        (-F.col("score")).alias("down"),
        F.col("key").isNull().alias("no_key"),
        "key",
        "mark",
        F.monotonically_increasing_id().alias("row"),
        "n_words",
        "n_features",
        "weight",
    )
    rows = stored(found, "scores")
    able = rows.where(F.col("n_words") >= min_words)
    k = percent * able.count() // 100
    out = [F.col("key").alias(key), "n_features", "weight", (-F.col("down")).alias("score")]
    unranked = F.lit(None).cast("long").alias("rank")
    if not k:
        return rows.select(*out, unranked)
    last = kth(able, _ORDER, k, pivots)
    drawn = (F.struct(*_ORDER) <= _literal(rows, _ORDER, last)) & (F.col("n_words") >= min_words)
    won = ranked(rows.where(drawn), _ORDER).select(*out, "rank")
    return won.unionByName(rows.where(~drawn).select(*out, unranked))
