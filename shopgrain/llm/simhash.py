"""SimHash near-duplicates by a self-join of binary tries.

A fingerprint has one bit per hash bit, set where more than half of the shingle hashes
have it set. Two documents are linked when their fingerprints differ in at most ``budget``
bits; the classes are the connected components of the links.

The join works on distinct fingerprints. It walks a binary trie against itself: a pair
of nodes carries the number of bits in which their paths differ, goes on to the pairs of
their children, and is dropped as soon as the number exceeds the budget. To spread that
over a cluster, the trie is laid out several times with the bits in another order. The 64
bits are cut into blocks; of any pair within the budget, at least ``blocks - budget``
blocks agree in full, so every choice of that many blocks heads one layout, and in it
only pairs of equal head are walked. Every link is found in at least one layout. The
number of blocks follows the number of fingerprints, so that a head keeps few of them.

A head that many fingerprints share (a hot group of near copies) is divided further: the
next bits of the path cut it into node pairs, and every pair whose paths differ by no more
than the budget is a task of its own. So no task holds an unbounded group, and nothing is
dropped. Node pairs are walked in strips of bounded size.

A walk yields a spanning forest of its links: as many edges as it can join classes, so a
group of copies never becomes all its pairs. The components of the edges are found by
alternating large-star and small-star steps on edge tables in the shared folder.

Nulls: a null text has no words and gets fingerprint zero, as an empty one; fingerprint
zero is linked like any other. Repeated rows share their class. A null id belongs to its
class and is never its name, unless all ids of the class are null. Extra columns stay in
``fingerprints``. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from shopgrain.session import stored

BITS = 64


def fingerprint(text: str | None, shingle: int = 4, seed: int = 42) -> int:
    """Majority bits of the XXH64 of all shingles (repeats included) of one text."""
    words = text.encode().lower().split() if text else []
    if not words:
        return 0
    joined = b" ".join(words)
    ends, at = [], -1
    for w in words:
        at += len(w) + 1
        ends.append(at)
    n = max(1, len(words) - shingle + 1)
    last = ends[shingle - 1 :] if len(words) >= shingle else [len(joined)]
    starts = [0, *(e + 1 for e in ends[: n - 1])]
    hash64 = xxhash.xxh64_intdigest
    hashes = np.array([hash64(joined[a:b], seed) for a, b in zip(starts, last)], ">u8")
    counts = np.zeros(BITS, np.int64)
    for i in range(0, n, 1 << 16):  # whole texts, a strip at a time
        counts += np.unpackbits(hashes[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > n).tobytes(), "big")


def _signed(n: int) -> int:
    return n - (1 << 64) if n >> 63 else n


def fingerprints(docs: DataFrame, shingle: int = 4, text: str = "text", out: str = "fingerprint") -> DataFrame:
    """``docs`` without the text, with the fingerprint as a (signed) long."""
    kept = docs.drop(out)
    at = kept.columns.index(text)
    schema = StructType([*(f for f in kept.schema.fields if f.name != text), StructField(out, LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [_signed(fingerprint(v, shingle)) for v in batch.column(at).to_pylist()]
            columns = [c for i, c in enumerate(batch.columns) if i != at]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(made, pa.int64())], names=schema.names)

    return kept.mapInArrow(run, schema)


def layouts(blocks: int, budget: int) -> list[tuple[tuple[int, ...], int]]:
    """(order of the bits from the top, bits of the head) of every trie layout."""
    cut = np.array_split(np.arange(BITS), blocks)
    found = []
    for head in combinations(range(blocks), blocks - budget):
        rest = [i for i in range(blocks) if i not in head]
        order = [int(b) for i in (*head, *rest) for b in cut[i]]
        found.append((tuple(order), sum(len(cut[i]) for i in head)))
    return found


def blocks_for(n: int, budget: int, head_rows: int) -> int:
    """The fewest blocks whose heads have room for ``n`` fingerprints, ``head_rows`` each.

    More blocks mean longer heads but more layouts: with b blocks a head has about
    64 (b - budget) / b bits.
    """
    blocks = budget + 1
    while blocks < budget + 4 and n > head_rows << (BITS * (blocks - budget) // blocks):
        blocks += 1
    return blocks


def permuted(values: np.ndarray, order: tuple[int, ...]) -> np.ndarray:
    """Unsigned 64-bit values with their bits (from the top) in another order."""
    bits = np.unpackbits(values.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)[:, list(order)]
    return np.packbits(bits, axis=1).reshape(-1, 8).copy().view(">u8").ravel().astype(np.uint64)


def walk(
    left: np.ndarray,
    right: np.ndarray,
    budget: int,
    start: int = 0,
    gone: int = 0,
    joined: Callable[[np.ndarray], np.ndarray] | None = None,
    strip: int = 1 << 18,
) -> Iterator[np.ndarray]:
    """Pairs of places (i, j) of two sorted arrays whose values differ in 1..budget bits.

    A node is a range of a sorted array (all values with one path). Node pairs go down
    together from bit ``start``; the differing bits (``gone`` above it) are added up and
    pairs beyond the budget are pruned, as are node pairs that ``joined`` marks as of one
    class already. ``left is right`` walks a trie against itself, and a pair of different
    nodes is then walked once. Node pairs are taken in strips of at most ``strip``; pairs
    of small nodes are finished directly.
    """
    same = left is right
    stack = [(start, np.array([[0, len(left), 0, len(right), gone]], np.int64))]
    while stack:
        bit, nodes = stack.pop()
        if len(nodes) > strip:
            half = len(nodes) // 2
            stack += [(bit, nodes[:half]), (bit, nodes[half:])]
            continue
        if joined is not None:
            nodes = nodes[~joined(nodes)]
        size = (nodes[:, 1] - nodes[:, 0]) * (nodes[:, 3] - nodes[:, 2])
        done = (size <= 64) | (bit == BITS)
        if done.any():
            yield from _leaves(left, right, nodes[done], budget, same, strip)
            nodes = nodes[~done]
        if not len(nodes):
            continue
        mid_a = _split(left, nodes[:, 0], nodes[:, 1], bit)
        mid_b = _split(right, nodes[:, 2], nodes[:, 3], bit)
        a0, a1, b0, b1, d = nodes.T
        children = [
            np.stack([a0, mid_a, b0, mid_b, d], 1),
            np.stack([mid_a, a1, mid_b, b1, d], 1),
            np.stack([a0, mid_a, mid_b, b1, d + 1], 1),
            np.stack([mid_a, a1, b0, mid_b, d + 1], 1),
        ]
        if same:  # of two mirrored pairs of a node with itself, one is enough
            children[3] = children[3][a0 != b0]
        new = np.concatenate(children)
        new = new[(new[:, 4] <= budget) & (new[:, 0] < new[:, 1]) & (new[:, 2] < new[:, 3])]
        if len(new):
            stack.append((bit + 1, new))


def _split(values: np.ndarray, start: np.ndarray, end: np.ndarray, bit: int) -> np.ndarray:
    """Where the values of each node turn from 0 to 1 in ``bit``: a binary search in step."""
    low, high = start.copy(), end.copy()
    mask = np.uint64(1 << (BITS - 1 - bit))
    while (open_ := low < high).any():
        mid = (low + high) // 2
        one = (values[np.minimum(mid, len(values) - 1)] & mask) > 0
        high = np.where(open_ & one, mid, high)
        low = np.where(open_ & ~one, mid + 1, low)
    return low


def _leaves(left, right, nodes, budget, same, strip) -> Iterator[np.ndarray]:
    """All value pairs of small node pairs, compared in full."""
    size = (nodes[:, 1] - nodes[:, 0]) * (nodes[:, 3] - nodes[:, 2])
    cuts = np.searchsorted(np.cumsum(size), np.arange(strip, size.sum() + strip, strip))
    for part in np.split(np.arange(len(nodes)), np.unique(cuts)[:-1] + 1):
        if not len(part):
            continue
        a0, _, b0, b1 = nodes[part, :4].T
        n = size[part]
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        width = np.repeat(b1 - b0, n)
        i, j = np.repeat(a0, n) + at // width, np.repeat(b0, n) + at % width
        differ = np.bitwise_count(left[i] ^ right[j])
        keep = (differ <= budget) & (differ > 0)
        if same:
            keep &= i != j
        if keep.any():
            yield np.stack([i[keep], j[keep]], 1)


class _Forest:
    """Classes of the values of one task: ``right`` places follow the ``left`` ones."""

    def __init__(self, n_left: int, n_right: int, same: bool) -> None:
        self.shift = 0 if same else n_left
        self.up = np.arange(n_left + (0 if same else n_right))

    def _settle(self) -> None:
        while ((top := self.up[self.up]) != self.up).any():
            self.up = top

    def joined(self, nodes: np.ndarray) -> np.ndarray:
        """Node pairs all of whose values are of one class."""
        self._settle()
        turns = np.concatenate([[0], np.cumsum(self.up[1:] != self.up[:-1])])
        a0, a1, b0, b1 = nodes[:, :4].T
        b0, b1 = b0 + self.shift, b1 + self.shift
        whole = (turns[a0] == turns[a1 - 1]) & (turns[b0] == turns[b1 - 1])
        return whole & (self.up[a0] == self.up[b0])

    def join(self, pairs: np.ndarray) -> list[int]:
        """Joins the classes of the pairs, in order; returns the numbers of those that did."""
        self._settle()
        i, j = self.up[pairs[:, 0]], self.up[pairs[:, 1] + self.shift]
        low, high = np.minimum(i, j), np.maximum(i, j)
        apart = np.flatnonzero(low != high)
        _, first = np.unique(low[apart] * len(self.up) + high[apart], return_index=True)
        up, used = self.up, []
        for k in apart[np.sort(first)].tolist():
            x, y = int(low[k]), int(high[k])
            while up[x] != x:
                x = int(up[x])
            while up[y] != y:
                y = int(up[y])
            if x != y:
                up[max(x, y)] = min(x, y)
                used.append(k)
        return used


EDGES = "a long, b long"


def links(prints: DataFrame, budget: int = 4, task_rows: int = 8192, head_rows: int = 256) -> DataFrame:
    """Edges (a, b) between distinct fingerprints that join all that the links join.

    ``prints`` has one row per distinct fingerprint and is read twice.
    """
    plan = layouts(blocks_for(prints.count(), budget, head_rows), budget)

    def lay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(0).to_numpy().astype(np.uint64)
            for n, (order, head) in enumerate(plan):
                path = permuted(values, order)
                yield pa.RecordBatch.from_pydict(
                    {
                        "layout": pa.array(np.full(len(path), n, np.int32)),
                        "head": pa.array((path >> np.uint64(BITS - head)).astype(np.int64)),
                        "path": pa.array(path.astype(np.int64)),
                    }
                )

    laid = prints.select("fingerprint").mapInArrow(lay, "layout int, head long, path long")
    counted = laid.groupBy("layout", "head").agg(F.count("*").alias("n")).where("n > 1")

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of a hot head go to all node pairs that their path takes part in."""
        for batch in batches:
            layout, head, path, n = (c.to_numpy() for c in batch.columns)
            more = np.maximum(np.ceil(np.log2(n / task_rows)), 0).astype(int)
            for t in np.unique(more):
                rows = more == t
                bits = min(int(t), BITS - max(h for _, h in plan))
                heads = np.array([h for _, h in plan])[layout[rows]]
                shift = (BITS - heads - bits).astype(np.uint64)
                node = (path[rows].astype(np.uint64) >> shift) & np.uint64((1 << bits) - 1)
                for k in range(min(budget, bits) + 1):
                    for flips in combinations(range(bits), k):
                        other = node ^ np.uint64(sum(1 << f for f in flips))
                        yield pa.RecordBatch.from_pydict(
                            {
                                "layout": pa.array(layout[rows]),
                                "head": pa.array(head[rows]),
                                "low": pa.array(np.minimum(node, other).astype(np.int64)),
                                "high": pa.array(np.maximum(node, other).astype(np.int64)),
                                "bits": pa.array(np.full(rows.sum(), bits, np.int32)),
                                "path": pa.array(path[rows]),
                            }
                        )

    dealt = (
        laid.join(counted, ["layout", "head"])
        .select("layout", "head", "path", "n")
        .mapInArrow(deal, "layout int, head long, low long, high long, bits int, path long")
    )
    task = ["layout", "head", "low", "high"]
    ordered = dealt.repartition(*task).sortWithinPartitions(*task)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for layout, low, high, bits, path in _tasks(batches):
            order, head = plan[layout]
            back = tuple(np.argsort(order))
            edges = _task_edges(np.sort(path), low, high, bits, head, budget)
            if len(edges):
                ends = permuted(edges.ravel(), back).astype(np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_pydict(
                    {"a": pa.array(ends.min(1)), "b": pa.array(ends.max(1))}
                )

    return ordered.mapInArrow(join, EDGES)


def _task_edges(path: np.ndarray, low: int, high: int, bits: int, head: int, budget: int) -> np.ndarray:
    """Forest edges (values) of one node pair; the walk starts below the common path."""
    start = head + bits
    node = (path >> np.uint64(BITS - start)) & np.uint64((1 << bits) - 1) if bits else None
    left = right = path
    if low != high:
        left, right = path[node == np.uint64(low)], path[node == np.uint64(high)]
    if not len(left) or not len(right):
        return np.empty((0, 2), np.uint64)
    forest = _Forest(len(left), len(right), low == high)
    kept = []
    for pairs in walk(left, right, budget, start, (low ^ high).bit_count(), forest.joined):
        # The closest pairs first, so that the forest prefers them.
        pairs = pairs[np.argsort(np.bitwise_count(left[pairs[:, 0]] ^ right[pairs[:, 1]]), kind="stable")]
        used = pairs[forest.join(pairs)]
        kept.append(np.stack([left[used[:, 0]], right[used[:, 1]]], 1))
    return np.concatenate(kept) if kept else np.empty((0, 2), np.uint64)


def _tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, int, int, np.ndarray]]:
    """Rows that stand together by task; a task may run over several batches."""
    held: list[np.ndarray] = []
    key: tuple | None = None
    for batch in batches:
        layout, head, low, high, bits, path = (c.to_numpy() for c in batch.columns)
        if not len(layout):
            continue
        new = (np.diff(layout) != 0) | (np.diff(head) != 0) | (np.diff(low) != 0) | (np.diff(high) != 0)
        cuts = [0, *(np.flatnonzero(new) + 1).tolist(), len(layout)]
        for a, b in zip(cuts, cuts[1:]):
            own = (int(layout[a]), int(head[a]), int(low[a]), int(high[a]), int(bits[a]))
            if own != key and held:
                yield key[0], *key[2:], np.concatenate(held)
                held = []
            key = own
            held.append(path[a:b].astype(np.uint64))
    if held:
        yield key[0], *key[2:], np.concatenate(held)


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of all nodes with an edge but the least of each component, which names it.

    Large-star hangs the larger neighbours of a node on its least one, small-star the
    smaller ones; both keep what is connected connected, and repeated they end in stars.
    A round is a few aggregations with a map-side combine, and its edges are written, so
    the plan does not grow and a lost executor repeats one round at most.
    """
    now = stored(edges.distinct(), "edges")
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("m").alias("a"), "b")
        large = large.where("a <> b").distinct()
        floor = large.groupBy(F.col("b").alias("n")).agg(F.min("a").alias("m"))
        small = (
            large.join(floor, F.col("b") == F.col("n"))
            .select("m", F.explode(F.array("a", "b")).alias("b"))
            .withColumnRenamed("m", "a")
            .where("a <> b")
            .distinct()
        )
        new = stored(small, "edges")
        now = new
        # Stars: no node is both a centre and a leaf, and no leaf has two centres.
        leaves = new.groupBy(F.col("b").alias("leaf")).agg(F.count("*").alias("n"))
        if leaves.where("n > 1").isEmpty() and new.join(leaves, F.col("a") == F.col("leaf"), "left_semi").isEmpty():
            break
    return now.select(F.col("b").alias("node"), F.col("a").alias("component"))


def classes(docs: DataFrame, key: str = "doc_id", shingle: int = 4, budget: int = 4, text: str = "text") -> DataFrame:
    """key, fingerprint and component_id (the least key of the class) of every row."""
    prints = stored(fingerprints(docs.select(key, text), shingle, text), "simhash")
    nodes = prints.groupBy("fingerprint").agg(F.min(key).alias("least"))
    stars = components(links(nodes.select("fingerprint"), budget))
    member = nodes.join(stars, F.col("fingerprint") == F.col("node"), "left").select(
        "fingerprint", "least", F.coalesce("component", "fingerprint").alias("component")
    )
    name = member.groupBy("component").agg(F.min("least").alias("component_id"))
    named = member.join(name, "component").select("fingerprint", "component_id")
    # One row per fingerprint on the right, so Spark may split a hot fingerprint.
    return prints.join(named, "fingerprint").select(key, "fingerprint", "component_id")


def hex_fingerprint(column: str = "fingerprint") -> F.Column:
    return F.lower(F.lpad(F.hex(column), 16, "0"))


def _free(columns: list[str], name: str) -> str:
    """``name``, with underscores added until no column is called so (in any case)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def first_copies(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 4, budget: int = 4) -> DataFrame:
    """``docs`` with one row of each class of ``classes``: the one with the least key.

    A null key comes first; among rows of one key the least hash of the whole row decides,
    so null and repeated keys are told apart by what they hold. Of rows that are equal in
    every column one stays. A null text is an empty one, and all empty texts are one class.
    Extra columns stay as they are, whatever their names; an empty table gives an empty one.
    """
    mark = _free(docs.columns, "row_hash")
    rows = docs.withColumn(mark, F.xxhash64(*(F.col(f"`{c}`") for c in docs.columns)))
    plain = rows.select(F.col(key).alias("key"), F.col(mark).alias("mark"), F.col(text).alias("text"))
    prints = stored(fingerprints(plain, shingle), "simhash")
    nodes = prints.groupBy("fingerprint").agg(F.min(F.struct(F.col("key").isNotNull(), "key", "mark")).alias("least"))
    nodes = stored(nodes, "simhash")
    stars = components(links(nodes.select("fingerprint"), budget))
    member = nodes.join(stars, F.col("fingerprint") == F.col("node"), "left").select(
        "least", F.coalesce("component", "fingerprint").alias("component")
    )
    first = member.groupBy("component").agg(F.min("least").alias("least")).select("least.key", "least.mark")
    first = stored(first.withColumnsRenamed({"key": "first_key", "mark": "first_mark"}), "simhash")
    same = rows[mark].eqNullSafe(first["first_mark"]) & rows[key].eqNullSafe(first["first_key"])
    kept = rows.join(first, same, "left_semi")
    # Rows that are equal in all columns: only where there are any is one of them chosen.
    again = prints.join(first, F.col("mark").eqNullSafe(F.col("first_mark")) & F.col("key").eqNullSafe(F.col("first_key")), "left_semi")
    if again.count() > first.count():
        kept = kept.dropDuplicates([key, mark])
    return kept.drop(mark)
