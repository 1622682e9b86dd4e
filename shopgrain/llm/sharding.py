"""Sharding by histogram sort, in DataFrame operations only.

Rows are ordered by a key and cut into shards of near equal bytes. The cuts are not
sampled: bytes below candidate boundaries ("probes") are counted exactly over all
partitions, the interval that holds a wanted cut is divided into new probes, and this
is repeated until every cut is within the tolerance or between two neighbouring keys.
Only then are the rows exchanged, once, as a whole: with their texts and all columns.

Probes are the borders of equal parts of an interval, ``fanout`` of one interval and
``PROBES`` of all at most. A row finds its interval by a binary search in the sorted list
of open ones and its part by arithmetic, so a plan does not grow with the cuts, and a
counting round is one aggregation with a map-side combine. It also tells the least and the
greatest key of each part, to which an interval shrinks; a part of one key is the end.

Ties: rows of one key are ordered by a second key drawn once per row when the rows are
first written, so even a key that holds a third of all rows can be cut anywhere.

Nulls: a null key sorts first; a null text has no bytes. Other columns travel packed, but
those named like the operator's own are not carried. An empty input gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shopgrain.session import stored

_LOW, _HIGH = -(2**63), 2**63  # bounds of a signed 64-bit key
LAW = "bytes"
PROBES = 1 << 16  # counted in one round
PLACE = ("size", "text_crc32", "law", "shard", "slot", "grown_shard")


@dataclass(frozen=True)
class Cut:
    """Rows up to the boundary (major, minor), itself excluded, lie below the cut."""

    major: int
    minor: int


def _others(docs: DataFrame, key: str, text: str) -> list[str]:
    return [c for c in docs.columns if c not in (key, text, *PLACE)]


def sized(docs: DataFrame, key: str = "doc_id", text: str = "text", overhead: int = 8) -> DataFrame:
    """Every row with its size and tie-breaker: key, text, all other columns in ``_rest``.

    ``_minor`` depends on the row's place in the input, so copies of a row differ in it;
    the caller writes the result once, which fixes it. Counting reads the narrow columns of
    what was written only.
    """
    size = F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + overhead
    others = _others(docs, key, text)
    return docs.select(
        F.col(key).cast("long").alias(key),
        F.col(text),
        *([F.struct(*(F.col(f"`{c}`") for c in others)).alias("_rest")] if others else []),
        size.alias("size"),
        F.coalesce(F.col(key).cast("long"), F.lit(_LOW)).alias("_major"),
        F.xxhash64(F.col(key), F.monotonically_increasing_id()).alias("_minor"),
    )


def _reached(borders: F.Column, n: int, value: F.Column) -> F.Column:
    """How many of the ``n`` sorted values of an array literal are at most ``value``."""
    steps = [1 << k for k in reversed(range(n.bit_length()))]

    def step(at: F.Column, more: F.Column) -> F.Column:
        # Beyond the array the place is null, which is not at most the value.
        further = (at + more <= n) & (F.get(borders, at + more - 1) <= value)
        return F.when(F.coalesce(further, F.lit(False)), at + more).otherwise(at)

    return F.reduce(F.array(*map(F.lit, steps)), F.lit(0), step)


def _literals(values: list[int], kind: str = "bigint") -> F.Column:
    """An array of numbers from one text, which Spark folds into a literal."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast(f"array<{kind}>")


def _probe(
    rows: DataFrame, column: str, targets: dict[int, float], low: int, high: int, tolerance: float, fanout: int
) -> dict[int, tuple[int, float]]:
    """For each wanted number of bytes, the key at or below which it is reached.

    Returns target number -> (key, bytes of all rows with a smaller key). Each round
    counts the bytes of equal parts of every open interval.
    """
    open_cuts = {t: (low, high, 0.0) for t in targets}
    done: dict[int, tuple[int, float]] = {}
    while open_cuts:
        spans = sorted({(a, b) for a, b, _ in open_cuts.values()})
        parts = max(2, min(fanout, PROBES // len(spans)))
        widths = [-(-(b - a) // parts) for a, b in spans]
        key, at = F.col(column), F.col("at") - 1
        # Decimal: the distance of two 64-bit keys may exceed 64 bits.
        offset = key.cast("decimal(20,0)") - F.get(_literals([a for a, _ in spans]), at).cast("decimal(20,0)")
        wide = F.get(_literals(widths, "decimal(20,0)"), at)
        inside = F.floor(offset / wide).cast("int")
        counted = (
            rows.select(column, "size", _reached(_literals([a for a, _ in spans]), len(spans), key).alias("at"))
            .where((F.col("at") > 0) & (key <= F.get(_literals([b - 1 for _, b in spans]), at)))
            .groupBy((at * parts + inside).alias("part"))
            .agg(F.sum("size").alias("bytes"), F.min(column).alias("least"), F.max(column).alias("most"))
        )
        # At most PROBES rows, or two for each open interval.
        found: dict[int, list[tuple]] = {}
        for r in counted.collect():
            found.setdefault(r["part"] // parts, []).append((r["part"] % parts, r["bytes"], r["least"], r["most"]))
        held = {span: sorted(found.get(n, [])) for n, span in enumerate(spans)}
        still = {}
        for t, (a, b, here) in open_cuts.items():
            crossing = None
            for _, size, least, most in held[a, b]:
                if here + size > targets[t]:
                    crossing = size, least, most
                    break
                here += size
            if crossing is None:
                done[t] = (b, here)
                continue
            size, least, most = crossing
            if targets[t] - here <= tolerance:
                done[t] = (least, here)
            elif least == most:
                # The nearer border of the one key that crosses the target.
                over = here + size - targets[t] < targets[t] - here
                done[t] = (least + 1, here + size) if over else (least, here)
            else:
                still[t] = (least, most + 1, here)
        open_cuts = still
    return done


def splitters(rows: DataFrame, cuts: int, tolerance: float = 0.001, fanout: int = 1024) -> list[Cut]:
    """The ``cuts`` boundaries that divide the bytes of ``rows`` evenly.

    ``tolerance`` is a share of a part's bytes. ``rows`` comes from a written table
    (see ``sized``), as it is counted again in each round.
    """
    total, low, high = rows.agg(F.sum("size"), F.min("_major"), F.max("_major")).first()
    if total is None:
        return []
    part = total / (cuts + 1)
    slack = part * tolerance
    targets = {i: part * (i + 1) for i in range(cuts)}
    first = _probe(rows, "_major", targets, low, high + 1, slack, fanout)
    found = {t: Cut(key, _LOW) for t, (key, _) in first.items()}
    # Cuts that fall inside the rows of one key go on with the second key.
    inside: dict[int, list[int]] = {}
    for t, (key, below) in first.items():
        if abs(below - targets[t]) > slack:
            inside.setdefault(key - 1 if below > targets[t] else key, []).append(t)
    if inside:
        heavy = {
            r["_major"]: r["bytes"]
            for r in rows.where(F.col("_major").isin(*inside))
            .groupBy("_major")
            .agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
            .where("n > 1")
            .collect()  # at most one row for each cut
        }
        for key, numbers in inside.items():
            if key in heavy:
                over = {t: first[t][1] > targets[t] for t in numbers}
                wanted = {t: targets[t] - first[t][1] + heavy[key] * over[t] for t in numbers}
                second = _probe(rows.where(F.col("_major") == key), "_minor", wanted, _LOW, _HIGH, slack, fanout)
                found |= {t: Cut(key, minor) for t, (minor, _) in second.items()}
    return [found[i] for i in range(cuts)]


def _passed(cuts: list[Cut]) -> F.Column:
    """How many of the cuts a row has behind it."""
    if not cuts:
        return F.lit(0)
    ordered = sorted((min(c.major, _HIGH - 1), min(c.minor, _HIGH - 1)) for c in cuts)
    pairs = F.arrays_zip(*map(_literals, zip(*ordered))).cast("array<struct<_major:bigint,_minor:bigint>>")
    return _reached(pairs, len(cuts), F.struct("_major", "_minor"))


def shard(
    docs: DataFrame,
    shards: int = 24,
    key: str = "doc_id",
    text: str = "text",
    tolerance: float = 0.001,
    fanout: int = 1024,
) -> DataFrame:
    """Every row whole, with size, law, shard, slot (gapless from 0 in each shard) and the
    checksum of the text as it lies there.

    Every shard is cut further into cells by the same splitters, as many as the session
    has shuffle partitions, so that the one exchange and the numbering of slots run in
    tasks of equal bytes; the table of cell counts has one row per cell.
    """
    spark = docs.sparkSession
    rows = stored(sized(docs, key, text), "shard-sizes")
    cells = -(-int(spark.conf.get("spark.sql.shuffle.partitions")) // shards)
    cuts = splitters(rows, shards * cells - 1, tolerance, fanout)
    placed = rows.withColumn("_cell", _passed(cuts)).withColumn("shard", F.floor(F.col("_cell") / cells).cast("int"))
    filled = placed.groupBy("shard", "_cell").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("shard").orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = filled.select("_cell", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    order = Window.partitionBy("_cell").orderBy("_major", "_minor")
    return (
        placed.withColumn("_at", F.row_number().over(order) - 1)
        # One row per cell, so bounded by the number of shuffle partitions plus shards.
        .join(F.broadcast(starts), "_cell")
        .select(
            key,
            text,
            *(F.col(f"_rest.`{c}`").alias(c) for c in _others(docs, key, text)),
            "size",
            F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("text_crc32"),
            F.lit(LAW).alias("law"),
            F.col("shard").cast("int").alias("shard"),
            (F.col("_start") + F.col("_at")).cast("long").alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"),
        )
    )
