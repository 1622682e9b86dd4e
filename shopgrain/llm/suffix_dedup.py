"""Removal of repeated byte strings by a depth-limited radix sort of suffixes.

A suffix is looked at through its first ``threshold`` bytes only, its window. Windows are
put into groups by digits, the most significant first; a group of one leaves as soon as it
is alone, and groups that are still equal after the last digit are exactly the repeated
windows. Every window but the first of its group covers bytes that go.

Digits are chosen so that neighbouring suffixes travel together. The first digit of a
window is its anchor: the ``gram`` bytes in it with the least hash. Equal windows have the
same anchor at the same place, and some forty neighbours share it, so a run of windows
with one anchor is one entry of the sort.

1. Pass one sorts the runs by (anchor, all bytes of the run). Runs that are equal to an
   earlier run are repeated as a whole. A run whose anchor no other run has is done.
2. Runs that share an anchor and differ elsewhere go on: their bytes are fetched, and
   their windows are sorted one by one.
3. An anchor that very many different runs share is dealt over several tasks in pass two;
   the first windows of each task meet in a last pass, sorted by Spark.

Digits are compared by hashes: 32 bits of the anchor and 64 of the run, or 128 of a
window. A task sorts its own runs first and sends one of each kind on, packed in arrays;
so a passage, or a group of copies, that many documents hold arrives once per task, and a
text of one repeated byte sends one run. What a task finds repeated goes straight to its
document. Texts are shuffled once, to meet their repeated spans.

Order: a smaller id is earlier, in one document the earlier start. A null id comes first.
Rows of one id are one rank: equal rows do not remove each other, and rows of one id with
different texts are taken in the order of a hash of the text.

Nulls: a null text is empty. Texts shorter than the threshold keep all bytes. Extra
columns are not carried. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shopgrain.session import stored

_PLACE = np.uint64((1 << 32) - 1)  # places within one strip of text
_MIX = np.uint64(0x9E3779B97F4A7C15)
RUN = np.dtype([("h", "u4"), ("c", "u8"), ("id", "i8"), ("tie", "i4"), ("lo", "i4"), ("hi", "i4")])
PACKED = "shard int, runs binary, spans binary"
SPAN = "id long, tie int, start int, end int"
FOUND = SPAN + ", kind int, anchor long, part int, hot boolean"  # kind 0: span, 1: run for pass two
SPAN_TYPE = np.dtype([("id", "i8"), ("tie", "i4"), ("start", "i4"), ("end", "i4")])


@cache
def _polynomial(seed: int) -> tuple[np.ndarray, int, int]:
    """Random values of the bytes, an odd base and its inverse modulo 2^64."""
    rng = np.random.default_rng(seed)
    base = int(rng.integers(1 << 62, 1 << 63, dtype=np.uint64)) | 5
    return rng.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1), base, pow(base, -1, 1 << 64)


_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    known = _POWERS.get(base)
    if known is None or len(known) < n:
        size = 1 << max(n - 1, 1).bit_length()
        made = np.full(size, base, np.uint64)
        made[0] = 1
        known = _POWERS[base] = np.multiply.accumulate(made)
    return known[:n]


class Hashes:
    """Hashes of any range of a text, from running sums of a polynomial modulo 2^64."""

    def __init__(self, data: np.ndarray, seed: int) -> None:
        values, base, self._inverse = _polynomial(seed)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(values[data] * _powers(base, len(data)), out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        back = _powers(self._inverse, len(self.sums))
        return (self.sums[end] - self.sums[start]) * back[start]

    def all(self, length: int) -> np.ndarray:
        """Of every range of one length."""
        n = len(self.sums) - length
        return (self.sums[length:] - self.sums[:n]) * _powers(self._inverse, n)


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Least of each ``width`` neighbours, by doubling."""
    out, have = values, 1
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[:-step], out[step:])
        have += step
    return out


def runs_of(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, threshold: int, gram: int) -> dict[str, np.ndarray]:
    """Runs of windows with one anchor, over texts that lie end to end in ``data``.

    Returns anchor hash, hash of the run's bytes, number of the text, first and last start.
    """
    sizes = ends - starts
    empty = {k: np.empty(0, t) for k, t in (("h", "u4"), ("c", "u8"), ("text", "i8"), ("lo", "i8"), ("hi", "i8"))}
    if len(data) < threshold or (sizes < threshold).all():
        return empty
    one = Hashes(data, 1)
    grams = one.all(gram) * _MIX
    key = (grams & ~_PLACE) | np.arange(len(grams), dtype=np.uint64)
    place = (sliding_min(key, threshold - gram + 1) & _PLACE).astype(np.int64)
    # Windows within a text, text by text.
    n = np.maximum(sizes - threshold + 1, 0)
    text = np.repeat(np.arange(len(starts)), n)
    at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + starts[text]
    anchor = place[at]
    first = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])]))
    last = np.append(first[1:], len(at)) - 1
    lo, hi, a = at[first], at[last], anchor[first]
    whole = Hashes(data, 2).of(lo, hi + threshold)
    whole ^= ((hi - lo).astype(np.uint64) << np.uint64(32)) + (a - lo).astype(np.uint64)
    whole *= _MIX
    whole ^= whole >> np.uint64(31)
    # Anchors have the least hashes; mixed again, they spread evenly over the shards.
    spread = grams[a] ^ (grams[a] >> np.uint64(32))
    spread *= _MIX
    spread ^= spread >> np.uint64(29)
    spread *= _MIX
    return {"h": (spread >> np.uint64(32)).astype("u4"), "c": whole, "text": text[first], "lo": lo, "hi": hi}


def settle(runs: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """(the first run of each kind, in order; spans that all other runs cover)."""
    if not len(runs):
        return runs, np.empty(0, SPAN_TYPE)
    runs = runs[np.lexsort((runs["lo"], runs["tie"], runs["id"], runs["c"], runs["h"]))]
    new = np.concatenate([[True], (runs["h"][1:] != runs["h"][:-1]) | (runs["c"][1:] != runs["c"][:-1])])
    first = runs[new]
    own = first[np.cumsum(new) - 1]
    later = (runs["id"] != own["id"]) | (runs["tie"] != own["tie"]) | (runs["lo"] != own["lo"])
    return first, merged_spans(runs["id"][later], runs["tie"][later], runs["lo"][later], runs["hi"][later] + threshold)


def merged_spans(ids: np.ndarray, ties: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Spans in order, those of a document that touch joined."""
    order = np.lexsort((starts, ties, ids))
    ids, ties, starts, ends = ids[order], ties[order], starts[order], ends[order].astype(np.int64)
    if not len(ids):
        return np.empty(0, SPAN_TYPE)
    new_doc = np.concatenate([[True], (ids[1:] != ids[:-1]) | (ties[1:] != ties[:-1])])
    # The farthest end so far in the document: ends are lifted by document to keep apart.
    doc = np.cumsum(new_doc)
    reach = np.maximum.accumulate(ends + (doc << 32)) - (doc << 32)
    new = new_doc | np.concatenate([[True], starts[1:] > reach[:-1]])
    first = np.flatnonzero(new)
    out = np.empty(len(first), SPAN_TYPE)
    out["id"], out["tie"], out["start"] = ids[first], ties[first], starts[first]
    out["end"] = reach[np.append(first[1:], len(ids)) - 1]
    return out


def _pack(rows: np.ndarray) -> bytes:
    """Columns one after the other, each byte by byte, compressed."""
    parts = []
    for name in rows.dtype.names:
        column = np.ascontiguousarray(rows[name])
        parts.append(column.view(np.uint8).reshape(len(rows), -1).T.tobytes())
    return zstandard.compress(b"".join(parts), 1)


def _unpack(data: bytes, kind: np.dtype) -> np.ndarray:
    flat = np.frombuffer(zstandard.decompress(data), np.uint8)
    n, at = len(flat) // kind.itemsize, 0
    out = np.empty(n, kind)
    for name in kind.names:
        size = kind[name].itemsize
        column = np.ascontiguousarray(flat[at : at + n * size].reshape(size, n).T)
        out[name] = column.view(kind[name]).ravel()
        at += n * size
    return out


def _sent(runs: np.ndarray, spans: np.ndarray, shards: int, turn: int) -> Iterator[pa.RecordBatch]:
    """Packed rows: the runs by ranges of their anchor, the spans to any shard."""
    bounds = np.array([(i << 32) // shards for i in range(1, shards)], np.uint64)
    cuts = [0, *np.searchsorted(runs["h"], bounds).tolist(), len(runs)]
    rows = [(s, _pack(runs[a:b]), b"") for s, (a, b) in enumerate(zip(cuts, cuts[1:])) if a < b]
    if len(spans):
        rows.append((turn % shards, b"", _pack(spans)))
    for shard, packed, other in rows:
        yield pa.RecordBatch.from_pydict(
            {
                "shard": pa.array([shard], pa.int32()),
                "runs": pa.array([packed], pa.binary()),
                "spans": pa.array([other], pa.binary()),
            }
        )


def _strips(batches: Iterator[pa.RecordBatch], room: int) -> Iterator[tuple[list[int], list[int], list[bytes]]]:
    """(ids, ties, texts) of about ``room`` bytes; a longer text is a strip of its own."""
    held, size = ([], [], []), 0
    parts = (batch.slice(i, 256) for batch in batches for i in range(0, batch.num_rows, 256))
    for part in parts:
        for row in zip(*(part.column(n).to_pylist() for n in ("id", "tie", "text"))):
            if held[0] and size + len(row[2]) > room:
                yield held
                held, size = ([], [], []), 0
            for column, value in zip(held, row):
                column.append(value)
            size += len(row[2])
    if held[0]:
        yield held


def _laid(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    sizes = np.array([len(t) for t in texts], np.int64)
    ends = np.cumsum(sizes)
    return np.frombuffer(b"".join(texts), np.uint8), ends - sizes, ends


def _span_batch(spans: np.ndarray, **more: np.ndarray) -> pa.RecordBatch:
    columns = {n: pa.array(spans[n]) for n in ("id", "tie", "start", "end")}
    return pa.RecordBatch.from_pydict(columns | {k: pa.array(v) for k, v in more.items()})


@dataclass(frozen=True)
class Settings:
    threshold: int = 100
    gram: int = 24
    strip_bytes: int = 1 << 18
    held_runs: int = 500_000  # runs that a task of pass one sorts at a time
    shard_bytes: int = 1 << 24  # bytes of text per shard of pass one
    task_runs: int = 4096  # different runs of one anchor that pass two takes in one piece


def _named(docs: DataFrame, key: str, text: str) -> DataFrame:
    data = F.coalesce(F.col(text), F.lit("")).cast("binary")
    return docs.select(
        F.col(key).alias("key"),
        F.coalesce(F.col(key).cast("long"), F.lit(-(2**63))).alias("id"),
        F.xxhash64(F.coalesce(F.col(text), F.lit(""))).bitwiseAND(F.lit(0x7FFFFFFF)).cast("int").alias("tie"),
        data.alias("text"),
    )


def _runs(docs: DataFrame, shards: int, s: Settings) -> DataFrame:
    """Pass one, before the shuffle: the runs of each task, one of each kind."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        waiting = turn = 0
        for ids, ties, texts in _strips(batches, s.strip_bytes):
            data, starts, ends = _laid(texts)
            found = runs_of(data, starts, ends, s.threshold, s.gram)
            rows = np.empty(len(found["h"]), RUN)
            text = found["text"]
            rows["h"], rows["c"] = found["h"], found["c"]
            rows["id"], rows["tie"] = np.array(ids, np.int64)[text], np.array(ties, np.int32)[text]
            rows["lo"], rows["hi"] = found["lo"] - starts[text], found["hi"] - starts[text]
            held.append(rows)
            waiting += len(rows)
            turn += len(ids)
            if waiting > s.held_runs:
                yield from _sent(*settle(np.concatenate(held), s.threshold), shards, turn)
                held, waiting = [], 0
        if waiting:
            yield from _sent(*settle(np.concatenate(held), s.threshold), shards, turn)

    return docs.select("id", "tie", "text").mapInArrow(run, PACKED)


def _sort_runs(packed: DataFrame, s: Settings) -> DataFrame:
    """Pass one, after the shuffle: spans, and the runs that share an anchor and differ."""

    def close(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        runs = np.concatenate(held)
        held.clear()
        runs, spans = settle(runs, s.threshold)
        if len(spans):
            yield _found(spans)
        new = np.concatenate([[True], runs["h"][1:] != runs["h"][:-1]])
        first = np.flatnonzero(new)
        size = np.diff(np.append(first, len(runs)))
        group = np.cumsum(new) - 1
        shared = size[group] > 1
        if shared.any():
            part = (np.arange(len(runs)) - first[group]) // s.task_runs
            hot = size[group] > s.task_runs
            out = np.empty(shared.sum(), SPAN_TYPE)
            rows = runs[shared]
            out["id"], out["tie"], out["start"], out["end"] = rows["id"], rows["tie"], rows["lo"], rows["hi"] + s.threshold
            yield _found(out, 1, rows["h"].astype(np.int64), part[shared].astype(np.int32), hot[shared])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for batch in batches:
            for runs, spans in zip(batch.column("runs"), batch.column("spans")):
                if len(spans.as_buffer()):
                    yield _found(_unpack(spans.as_py(), SPAN_TYPE))
                if len(runs.as_buffer()):
                    held.append(_unpack(runs.as_py(), RUN))
        if held:
            yield from close(held)

    return packed.mapInArrow(run, FOUND)


def _found(spans: np.ndarray, kind: int = 0, anchor=None, part=None, hot=None) -> pa.RecordBatch:
    n = len(spans)
    return _span_batch(
        spans,
        kind=np.full(n, kind, np.int32),
        anchor=np.zeros(n, np.int64) if anchor is None else anchor,
        part=np.zeros(n, np.int32) if part is None else part,
        hot=np.zeros(n, bool) if hot is None else hot,
    )


CONTEXT = "anchor long, part int, hot boolean, id long, tie int, start int, bytes binary"
WINDOWS = SPAN + ", kind int, d1 long, d2 long"  # kind 0: span, 2: first window of a hot part


def _contexts(docs: DataFrame, found: DataFrame) -> DataFrame:
    """The bytes of the runs that go on to pass two."""
    runs = found.where("kind = 1").groupBy("id", "tie").agg(
        # At most the runs of one text.
        F.collect_list(F.struct("anchor", "part", "hot", "start", "end")).alias("runs")
    )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, tie, text, runs in zip(*(batch.column(n) for n in ("id", "tie", "text", "runs"))):
                data, rows = text.as_py(), runs.values
                starts, ends = rows.field("start").to_pylist(), rows.field("end").to_pylist()
                yield pa.RecordBatch.from_arrays(
                    [
                        rows.field("anchor"),
                        rows.field("part"),
                        rows.field("hot"),
                        pa.array([doc.as_py()] * len(starts), pa.int64()),
                        pa.array([tie.as_py()] * len(starts), pa.int32()),
                        rows.field("start"),
                        pa.array([data[a:b] for a, b in zip(starts, ends)], pa.binary()),
                    ],
                    names=["anchor", "part", "hot", "id", "tie", "start", "bytes"],
                )

    joined = docs.select("id", "tie", "text").join(runs, ["id", "tie"])
    return joined.mapInArrow(cut, CONTEXT)


def _sort_windows(contexts: DataFrame, s: Settings) -> DataFrame:
    """Pass two: windows of the runs of one anchor (or of one part of a hot one)."""

    def close(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        hot, ids, ties, starts, texts = zip(*held)
        data, begin, end = _laid(list(texts))
        n = end - begin - s.threshold + 1
        run = np.repeat(np.arange(len(texts)), n)
        step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        at = begin[run] + step
        d1, d2 = (Hashes(data, seed).of(at, at + s.threshold) for seed in (3, 4))
        doc, tie = np.array(ids, np.int64)[run], np.array(ties, np.int32)[run]
        start = np.array(starts, np.int64)[run] + step
        order = np.lexsort((start, tie, doc, d2, d1))
        d1, d2, doc, tie, start = d1[order], d2[order], doc[order], tie[order], start[order]
        new = np.concatenate([[True], (d1[1:] != d1[:-1]) | (d2[1:] != d2[:-1])])
        own = np.flatnonzero(new)[np.cumsum(new) - 1]
        later = (doc != doc[own]) | (tie != tie[own]) | (start != start[own])
        spans = merged_spans(doc[later], tie[later], start[later], start[later] + s.threshold)
        zero = np.zeros(len(spans), np.int64)
        if len(spans):
            yield _span_batch(spans, kind=zero.astype(np.int32), d1=zero, d2=zero)
        send = new & np.array(hot, bool)[run][order]
        if send.any():
            rows = np.empty(send.sum(), SPAN_TYPE)
            rows["id"], rows["tie"], rows["start"], rows["end"] = doc[send], tie[send], start[send], start[send] + s.threshold
            kind = np.full(len(rows), 2, np.int32)
            yield _span_batch(rows, kind=kind, d1=d1[send].astype(np.int64), d2=d2[send].astype(np.int64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, group, held = None, [], []
        for batch in batches:
            for anchor, part, *row in zip(*(c.to_pylist() for c in batch.columns)):
                if (anchor, part) != now:
                    # Whole groups only, so that no group is cut without being hot.
                    if held and len(held) + len(group) > s.task_runs:
                        yield from close(held)
                        held = []
                    held += group
                    now, group = (anchor, part), []
                group.append(row)
        if held and len(held) + len(group) > s.task_runs:
            yield from close(held)
            held = []
        held += group
        if held:
            yield from close(held)

    dealt = contexts.repartition("anchor", "part").sortWithinPartitions("anchor", "part")
    return dealt.mapInArrow(run, WINDOWS)


def _sort_hot(windows: DataFrame) -> DataFrame:
    """Last pass: first windows of the parts of hot anchors.

    Only the first window of a part is here, so a window that all documents hold has one
    row per part; the join to the least one can be split.
    """
    rows = windows.where("kind = 2")
    least = rows.groupBy("d1", "d2").agg(F.min(F.struct("id", "tie", "start")).alias("first"), F.count("*").alias("n"))
    later = F.struct("id", "tie", "start") > F.col("first")
    return rows.join(least.where("n > 1"), ["d1", "d2"]).where(later).select("id", "tie", "start", "end")


def repeated(docs: DataFrame, s: Settings = Settings(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, text (bytes) and the maximal spans (start, end) to remove, of every row."""
    spark = docs.sparkSession
    named = _named(docs, key, text)
    total = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // s.shard_bytes))
    packed = _runs(named, shards, s).repartitionById(shards, "shard")  # one shard to a task
    found = stored(_sort_runs(packed, s), "repeats")
    windows = stored(_sort_windows(_contexts(named, found), s), "repeats")
    span = ["id", "tie", "start", "end"]
    spans = found.where("kind = 0").select(*span).unionByName(windows.where("kind = 0").select(*span))
    spans = spans.unionByName(_sort_hot(windows))
    # At most the spans of one text.
    by_text = spans.groupBy("id", "tie").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("found"))
    joined = named.join(by_text, ["id", "tie"], "left").select("key", "text", "found")

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        for batch in batches:
            out = []
            for row in batch.column("found"):
                done: list[dict] = []
                if row.is_valid:
                    pairs = zip(row.values.field("start").to_pylist(), row.values.field("end").to_pylist())
                    for a, b in pairs:
                        if done and a <= done[-1]["end"]:
                            done[-1]["end"] = max(done[-1]["end"], b)
                        else:
                            done.append({"start": a, "end": b})
                out.append(done)
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), batch.column("text"), pa.array(out, kind)], names=["key", "text", "spans"]
            )

    kind = docs.schema[key].dataType.simpleString()
    made = joined.mapInArrow(join, f"key {kind}, text binary, spans array<struct<start: int, end: int>>")
    return made.withColumnsRenamed({"key": key, "text": text})


def kept_bytes(data: bytes, spans: list[dict]) -> bytes:
    """The bytes outside the spans."""
    at, parts = 0, []
    for span in spans:
        parts.append(data[at : span["start"]])
        at = span["end"]
    return b"".join([*parts, data[at:]])


def digest(found: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Sizes, and a digest of the bytes that stay."""
    kind = found.schema[key].dataType.simpleString()
    names = [key, "n_bytes", "n_removed", "n_spans", "kept_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for data, spans in zip(batch.column(text).to_pylist(), batch.column("spans").to_pylist()):
                kept = kept_bytes(data, spans)
                rows.append((len(data), len(data) - len(kept), len(spans), hashlib.sha256(kept).hexdigest()))
            columns = list(zip(*rows)) or [[]] * 4
            types = [pa.int64(), pa.int64(), pa.int64(), pa.string()]
            made = [pa.array(list(c), t) for c, t in zip(columns, types)]
            yield pa.RecordBatch.from_arrays([batch.column(key), *made], names=names)

    return found.select(key, text, "spans").mapInArrow(
        run, f"{key} {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    )
