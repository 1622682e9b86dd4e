"""Benchmark decontamination by a prefix-filtered set join.

An item is the set of its windows of ``window`` consecutive words (an item with fewer
words is one window of its own length). A document is hit where a window occurs in it as
a whole.

The join does not compare windows with windows. The words of a window are ordered by
rarity, counted over all documents; a window that must be contained whole needs its
rarest word, so that one word is its prefix. Documents are probed for prefix words only.
A hit word proposes (window, place of the word in it), which fixes where the window would
start; the start must not lie before the text (positional bound) and the window must end
within it (length bound). What is left is compared word by word.

Rarity is counted for the words that items have; it only decides the order, so it changes
cost and not results.

Items travel to the tasks in blocks of at most ``block_bytes`` of text. Each block is a
pass over the documents, so the broadcast is bounded however large the benchmark is, and
no item is left out. One block is the usual case. Documents are never shuffled, so a hot
passage costs each document only its own hits.

Nulls: a null text has no words and is not hit; an item with a null text or no words has
no window; a null item id counts as an item named ''. Repeated item rows count once; document rows are answered row by
row, copies included. Extra columns stay; columns named like the operator's own are
replaced. An empty benchmark hits nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

# Lower case for A-Z; bytes that are not 0-9, a-z or part of a longer code point part words.
_FOLD = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)

HITS = "n_words long, n_hit long, items array<string>, hits array<struct<start: int, end: int>>"


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` as UTF-8."""
    return text.encode().translate(_FOLD).split() if text else []


def windows_of(words: list[bytes], window: int) -> Iterator[tuple[bytes, ...]]:
    if words:
        for i in range(max(1, len(words) - window + 1)):
            yield tuple(words[i : i + window])


def rarity(docs: DataFrame, vocabulary: set[bytes], text: str = "text") -> dict[bytes, int]:
    """How often each word of ``vocabulary`` occurs in all documents.

    Counts are combined in each task, so at most a row per task and word is shuffled, and
    at most a row per word of the item block comes back.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, seen = shared.value, {}
        for batch in batches:
            for value in batch.column(0).to_pylist():
                for w in filter(wanted.__contains__, words_of(value)):
                    seen[w] = seen.get(w, 0) + 1
        yield pa.RecordBatch.from_pydict(
            {"word": pa.array(seen.keys(), pa.binary()), "n": pa.array(seen.values(), pa.int64())}
        )

    counted = docs.select(text).mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return {bytes(r["word"]): r["n"] for r in counted.collect()}


def prefix_index(
    items: list[tuple[str, str]], window: int, count: dict[bytes, int]
) -> dict[bytes, list[tuple[int, tuple[bytes, ...], tuple[str, ...]]]]:
    """Rarest word -> (its place, window, ids of the items that have the window)."""
    owners: dict[tuple[bytes, ...], set[str]] = {}
    for item_id, text in items:
        for w in windows_of(words_of(text), window):
            owners.setdefault(w, set()).add(item_id)
    found: dict[bytes, list] = {}
    for w, ids in owners.items():
        place = min(range(len(w)), key=lambda i: (count.get(w[i], 0), w[i]))
        found.setdefault(w[place], []).append((place, w, tuple(sorted(ids))))
    return found


def contained(words: list[bytes], index: dict) -> tuple[list[tuple[int, int]], set[str]]:
    """Spans of words that equal a window (end exclusive), and the items found."""
    spans, ids, n = [], set(), len(words)
    for at, rare in [(i, w) for i, w in enumerate(words) if w in index]:
        for place, window, owners in index[rare]:
            start = at - place
            if start < 0 or start + len(window) > n:
                continue
            if tuple(words[start : start + len(window)]) == window:
                spans.append((start, start + len(window)))
                ids.update(owners)
    return spans, ids


def merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Disjoint spans in order."""
    merged: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if merged and start <= merged[-1][1]:
            merged[-1] = (merged[-1][0], max(end, merged[-1][1]))
        else:
            merged.append((start, end))
    return merged


def blocks(items: DataFrame, block_bytes: int, item_id: str, text: str) -> Iterator[list[tuple[str, str]]]:
    """The items, a bounded block at a time; the driver never holds two blocks."""
    rows = items.select(
        F.coalesce(F.col(item_id).cast("string"), F.lit("")), F.coalesce(F.col(text), F.lit(""))
    ).distinct()
    held, size = [], 0
    for row in rows.toLocalIterator():
        more = len(row[1].encode()) + 64
        if held and size + more > block_bytes:
            yield held
            held, size = [], 0
        held.append((row[0], row[1]))
        size += more
    if held:
        yield held


def find(
    docs: DataFrame,
    items: DataFrame,
    window: int = 10,
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    block_bytes: int = 4 << 20,
) -> DataFrame:
    """``docs`` with n_words, n_hit, items (sorted ids) and hits (spans of words)."""
    own = StructType.fromDDL(HITS)
    found = docs.drop(*own.names).withColumns(
        {f.name: F.array().cast(f.dataType) if f.name in ("items", "hits") else F.lit(0).cast(f.dataType) for f in own}
    )
    done = False
    for held in blocks(items, block_bytes, item_id, item_text):
        vocabulary = {w for _, t in held for w in words_of(t)}
        found = _probe(found, prefix_index(held, window, rarity(docs, vocabulary, text)), text)
        done = True
    return found if done else _probe(found, {}, text)


def _probe(found: DataFrame, index: dict, text: str) -> DataFrame:
    """Adds the hits of one block to those found so far."""
    shared = found.sparkSession.sparkContext.broadcast(index)  # bounded by block_bytes
    names = found.columns
    at, first = names.index(text), len(names) - 4
    fields = list(to_arrow_schema(StructType.fromDDL(HITS)))

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            new = []
            before = (batch.column(first + 2).to_pylist(), batch.column(first + 3).to_pylist())
            for value, ids, spans in zip(batch.column(at).to_pylist(), *before):
                words = words_of(value)
                more, owners = contained(words, shared.value)
                merged = merge([(s["start"], s["end"]) for s in spans] + more)
                hits = [{"start": a, "end": b} for a, b in merged]
                new.append((len(words), sum(b - a for a, b in merged), sorted(owners.union(ids)), hits))
            columns = list(zip(*new)) or [[]] * 4
            made = [pa.array(list(v), f.type) for v, f in zip(columns, fields)]
            yield pa.RecordBatch.from_arrays(batch.columns[:first] + made, names=names)

    return found.mapInArrow(probe, found.schema)


def digest(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """Counts and a digest of the item ids; no text."""
    return found.select(
        key,
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )
