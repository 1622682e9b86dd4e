"""Join of texts by the Jaccard similarity of their word n-grams, through a token-group matrix.

A text's set holds its distinct ``shingle``-word shingles (fewer words: the whole sequence as
one), as 64-bit hashes. Two texts are linked when 100 * intersection >= ``percent`` * union,
and a class is all that links connect. Texts of one set are one node, so copies are handled
once. Results are exact up to collisions of the hashes.

1. Only nodes that share a token of their prefixes can have a link: of the tokens of a set in
   one order for all sets, as many as a similar set must meet one of. The order is by how
   frequent a token is, then by hash. Frequencies come from lossy counting over all texts: a
   task counts windows of a bounded number of tokens and reports what it saw twice or more,
   so a token in more texts than there are windows is never missed. Frequencies only decide
   how many groups are met, not which links are found.
2. Similar nodes are put into groups: nodes with the same least token hash of their whole set,
   as most similar sets have, cut by hash into parts of bounded size. All sets of a group are compared in one task, which goes on only
   for pairs that are not yet connected. What was cut is grouped once more by another hash,
   so a large group of near copies is connected without all its pairs. Nodes that still meet
   other classes under a second or third hash of their tokens are grouped by it as well.
3. The classes so far, cut into parts of bounded size and of sets of about one size, become
   the groups of the matrix (single nodes keep the groups of step 2). The matrix has a row for
   each token and group that has it in the prefix of a member, and for each group the union
   of the tokens of its members. A node queries the groups of larger classes: first the tokens
   that its prefix shares with the group's rows are counted, and a group goes on if a member
   of its sizes could be similar with so many (prefixes longer by l share l tokens more); then
   the overlap of the whole set with the group's union bounds the overlap with any member;
   and only a group whose bound is large enough is opened and its members compared.

So every pair of nodes is in one class already, or compared, or excluded by a bound. Groups
have bounded sizes, queries of a hot group are dealt over several tasks, and only links that
connect are kept. Tokens that very many prefixes hold are told by the list of frequent ones
(``frequent`` entries at most, broadcast) and not brought together in one task.

Nulls: a null text has no words, as an empty one; its set is empty and linked with nothing.
A null key belongs to its class and names it only where no member has a key. Repeated rows
are members of one class. An empty table gives an empty result. Extra columns are left out.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shopgrain.llm.frequent import most_frequent
from shopgrain.llm.simhash import components
from shopgrain.session import stored

_MIX = np.uint64(0x9E3779B97F4A7C15)
_SEEN = 1 << 20  # texts of which a task remembers that it saw them
_WINDOW = 1 << 20  # tokens of a counting window
_BAND = 1.06  # the largest set of a group of the matrix by the smallest, about


def token_set(text: bytes | None, shingle: int) -> np.ndarray:
    """Distinct shingle hashes in order, with A-Z in lower case."""
    words = text.lower().split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    h = np.frombuffer(b"".join(map(xxhash.xxh3_64_digest, words)), ">u8").astype(np.uint64)
    size = min(shingle, len(words))
    n = len(words) - size + 1
    made = np.full(n, size, np.uint64)
    for k in range(size):
        made = (made ^ (made >> np.uint64(29))) * _MIX + h[k : k + n]
    made = (made ^ (made >> np.uint64(32))) * _MIX
    return np.unique(made ^ (made >> np.uint64(29)))


def _node(tokens: np.ndarray) -> int:
    n = xxhash.xxh64_intdigest(tokens.tobytes(), 13)
    return n - (1 << 64) if n >> 63 else n


def needed(n: int, percent: int) -> int:
    """The least overlap of a set of ``n`` with a similar one, which has as many at least."""
    return -(-percent * n // 100)


def similar(overlap: np.ndarray, n: int, sizes: np.ndarray, percent: int) -> np.ndarray:
    return 100 * overlap >= percent * (n + sizes - overlap)


def prefix(tokens: np.ndarray, frequent: np.ndarray, times: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """The rarest tokens, one of which any similar set must have in its own, and which are frequent."""
    n = len(tokens)
    seen = np.zeros(n, np.int64)
    if len(frequent) and n:
        at = np.minimum(np.searchsorted(frequent, tokens), len(frequent) - 1)
        seen = np.where(frequent[at] == tokens, times[at], 0)
    best = np.lexsort((tokens, seen))[: n - needed(n, percent) + 1 if n else 0]
    return tokens[best], seen[best] > 0


class Index:
    """The sets of a group, so that one set's overlap with all of them is a few array operations."""

    def __init__(self, sets: list[np.ndarray]) -> None:
        self.sizes = np.array([len(s) for s in sets], np.int64)
        joined = np.concatenate(sets)
        order = np.argsort(joined, kind="stable")
        self.owner = np.repeat(np.arange(len(sets)), self.sizes)[order]
        self.union, self.start = np.unique(joined[order], return_index=True)
        self.end = np.append(self.start[1:], len(joined))

    def overlaps(self, tokens: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.union, tokens), len(self.union) - 1)
        at = at[self.union[at] == tokens]
        n = self.end[at] - self.start[at]
        places = np.arange(n.sum()) + np.repeat(self.start[at] - np.cumsum(n) + n, n)
        return np.bincount(self.owner[places], minlength=len(self.sizes))


def links_within(sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links that connect whatever the links of these sets connect."""
    found, label = [], np.arange(len(sets))
    index = Index(sets)
    for i, tokens in enumerate(sets):
        apart = label != label[i]
        apart[:i] = False
        if not apart.any():
            continue
        for j in np.flatnonzero(apart & similar(index.overlaps(tokens), len(tokens), index.sizes, percent)).tolist():
            if label[j] != label[i]:
                found.append((i, j))
                label[label == label[j]] = label[i]
    return found


def _body(docs: DataFrame, text: str, *columns: Column) -> DataFrame:
    return docs.select(*columns, F.coalesce(F.col(text).cast("binary"), F.lit(b"")).alias("body"))


def _nodes(docs: DataFrame, key: str, text: str, shingle: int) -> DataFrame:
    """key, node and n (size of the set) of every row."""
    plain = _body(docs, text, F.col(key).alias("key"))
    schema = plain.select("key", F.lit(0).cast("long").alias("node"), F.lit(0).alias("n")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [token_set(v.as_py(), shingle) for v in batch.column(1)]
            made = [pa.array([_node(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int32())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *made], names=schema.names)

    return plain.mapInArrow(run, schema)


def frequent_tokens(docs: DataFrame, text: str, shingle: int, limit: int, least: int = 16) -> dict[int, int]:
    """Tokens of many texts and in how many they were counted (see the module's step 1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def counted() -> pa.RecordBatch:
            tokens, n = np.unique(np.concatenate(held), return_counts=True)
            again = n > 1
            return pa.RecordBatch.from_arrays([pa.array(tokens[again].view(np.int64)), pa.array(n[again])], names=["token", "n"])

        for batch in batches:
            for value in batch.column(0):
                held.append(token_set(value.as_py(), shingle))
                size += len(held[-1])
                if size >= _WINDOW:
                    yield counted()
                    held, size = [], 0
        if held:
            yield counted()

    found = _body(docs, text).mapInArrow(run, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    return {r["token"] % (1 << 64): r["n"] for r in most_frequent(found.where(F.col("n") >= least), "token", limit)}


_PREFIX = "token long, node long, n int, least long, hot boolean"


def _prefixes(docs: DataFrame, text: str, shingle: int, percent: int, frequent: dict[int, int]) -> DataFrame:
    """Prefix rows (token, node, n, least, hot), each once, of tokens that another node may have too.

    ``least`` is the least token of the whole set.
    """
    known = np.array(sorted(frequent), np.uint64)
    times = np.array([frequent[t] for t in sorted(frequent)], np.int64)
    shared = docs.sparkSession.sparkContext.broadcast((known, times))  # bounded by ``frequent``
    names = [c.split()[0] for c in _PREFIX.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            parts, rows = [], 0
            for value in batch.column(0):
                tokens = token_set(value.as_py(), shingle)
                node = _node(tokens)
                if node in seen:
                    continue
                if len(seen) >= _SEEN:
                    seen.clear()
                seen.add(node)
                best, hot = prefix(tokens, *shared.value, percent)
                n = len(best)
                sizes, least = np.full(n, len(tokens), np.int32), np.repeat(tokens[:1].view(np.int64), n)
                parts.append((best.view(np.int64), np.full(n, node, np.int64), sizes, least, hot))
                rows += n
                if rows > 200_000:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*parts)], names=names)
                    parts, rows = [], 0
            if parts:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*parts)], names=names)

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of rows sorted by token and node, one of each whose token is frequent or has several nodes."""
        last, linked = None, False  # the row that waits for the next one
        for batch in batches:
            rows = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            if last is not None:
                rows = [np.concatenate(c) for c in zip(last, rows)]
            if not len(rows[0]):
                continue
            same = (rows[0][1:] == rows[0][:-1]) & (rows[1][1:] == rows[1][:-1])
            rows = [c[np.append(True, ~same)] for c in rows]
            met = rows[0][1:] == rows[0][:-1]
            before = np.append(linked, met)
            keep = before[:-1] | met | rows[4][:-1]
            yield pa.RecordBatch.from_arrays([pa.array(c[:-1][keep]) for c in rows], names=names)
            last, linked = [c[-1:] for c in rows], bool(before[-1])
        if last is not None and (linked or last[4][0]):
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in last], names=names)

    made = _body(docs, text).mapInArrow(run, _PREFIX)
    # Few prefixes share a token that is not frequent, so these meet. The rows of frequent
    # ones are dealt by node, and stay without being counted.
    apart = F.when(F.col("hot"), F.col("node"))
    return made.repartition("token", apart).sortWithinPartitions("token", "node").mapInArrow(again, _PREFIX)


_TEXTS = "node long, n int, part long, again long, hash1 long, hash2 long, body binary"
_BROADCAST = 2_000_000  # rows of one or two numbers that each task may hold


def _checked(rows: DataFrame) -> DataFrame:
    """``rows`` (a written table) marked for a broadcast if they are few enough to be held."""
    return F.broadcast(rows) if rows.count() <= _BROADCAST else rows


def _least(tokens: np.ndarray, seed: int) -> int:
    """The least of the tokens in another order, which similar sets mostly have in common."""
    mixed = (tokens ^ np.uint64(seed * 0x5851F42D4C957F2D % (1 << 64))) * _MIX
    return int((mixed ^ (mixed >> np.uint64(31))).min().view(np.int64))


def _texts(docs: DataFrame, text: str, shingle: int, live: DataFrame) -> DataFrame:
    """One text of each of the ``live`` nodes (node, n, part, again), compressed."""
    names = [c.split()[0] for c in _TEXTS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        pack = zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            rows = []
            for value in batch.column(0):
                body = value.as_py()
                tokens = token_set(body, shingle)
                node = _node(tokens)
                if node not in seen and len(tokens):
                    rows.append((node, len(tokens), None, None, _least(tokens, 1), _least(tokens, 2), pack(body)))
                if len(seen) >= _SEEN:
                    seen.clear()
                seen.add(node)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * len(names), types)], names=names
            )

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The first text of each node that is marked live: the mark has a part and comes before."""
        marked = part = again = done = None
        for batch in batches:
            keep, parts, agains = [], [], []
            for node, own, more in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3))):
                if own is not None:
                    marked, part, again = node, own, more
                keep.append(own is None and node == marked and node != done)
                parts.append(part)
                agains.append(again)
                if keep[-1]:
                    done = node
            columns = [*batch.columns[:2], pa.array(parts, pa.int64()), pa.array(agains, pa.int64()), *batch.columns[4:]]
            yield pa.RecordBatch.from_arrays(columns, names=names).filter(pa.array(keep, pa.bool_()))

    types = [{"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}[c.split()[1]] for c in _TEXTS.split(", ")]
    made = _body(docs, text).where(F.length("body") > 0).mapInArrow(run, _TEXTS)
    none = [F.lit(None).cast(c.split()[1]).alias(c.split()[0]) for c in _TEXTS.split(", ")[4:]]
    marks = live.select("node", "n", "part", "again", *none)
    order = ["node", F.col("part").isNull()]
    return made.unionByName(marks).repartition("node").sortWithinPartitions(*order).mapInArrow(first, _TEXTS)


def _unpacked_set(body: bytes, shingle: int) -> np.ndarray:
    return token_set(zstandard.decompress(body), shingle)


def _cut(rows: DataFrame, by: str, salt: int, most: int, tokens: int) -> DataFrame:
    """``rows`` with ``cuts``, into how many parts its ``by`` is cut, and ``part`` (a number of its own)."""
    sizes = rows.groupBy(by).agg(F.count("*").alias("together"), F.sum("n").alias("_tokens"))
    cuts = F.ceil(F.greatest(F.col("together") / most, F.col("_tokens") / tokens)).cast("long")
    sized = rows.join(sizes.select(by, "together", cuts.alias("cuts")), by)
    return sized.withColumn("part", F.xxhash64(by, F.pmod(F.xxhash64("node", F.lit(salt)), "cuts"), F.lit(salt)))


_EDGES = "a long, b long"


def _edges(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    a, b = np.array(pairs, np.int64).reshape(-1, 2).T
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])


def _runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, Iterator[tuple]]]:
    """Rows that stand together by their first ``keys`` columns, one run after the other."""
    def rows() -> Iterator[tuple]:
        for batch in batches:
            yield from zip(*(c.to_pylist() for c in batch.columns))

    for key, run in groupby(rows(), lambda r: r[:keys]):
        yield key, run


def _join_groups(grouped: DataFrame, shingle: int, percent: int) -> DataFrame:
    """Links within the groups (``part``) of texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _runs(batches, 1):
            nodes, sets = [], []
            for _, node, body in rows:
                nodes.append(node)
                sets.append(_unpacked_set(body, shingle))
            if len(nodes) > 1:
                found = links_within(sets, percent)
                if found:
                    yield _edges([(nodes[i], nodes[j]) for i, j in found])

    return grouped.select("part", "node", "body").repartition("part").sortWithinPartitions("part").mapInArrow(run, _EDGES)


def _unions(members: DataFrame, texts: DataFrame, shingle: int) -> DataFrame:
    """The token union of each group, and the sizes of its smallest and largest set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (group,), rows in _runs(batches, 1):
            sets = [_unpacked_set(body, shingle) for _, body in rows]
            union, sizes = np.unique(np.concatenate(sets)), [len(s) for s in sets]
            columns = [[group], [min(sizes)], [max(sizes)], [union.tobytes()]]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int32(), pa.binary()))],
                names=["part", "least", "most", "tokens"],
            )

    rows = members.join(texts, "node").select("part", "body").repartition("part").sortWithinPartitions("part")
    return rows.mapInArrow(run, "part long, least int, most int, tokens binary")


def _meet(held: DataFrame, queries: DataFrame, work: Callable, schema: str, most: int) -> DataFrame:
    """Brings the queries of a group to what is held of it; ``work`` gets one group at a time.

    ``held`` has part, node, owner, body; ``queries`` has part, node, body. A group of more
    than ``most`` queries is met in several tasks, each with all that is held.
    """
    times = queries.groupBy("part").agg(F.ceil(F.count("*") / most).cast("int").alias("salts"))
    one = F.pmod(F.xxhash64("node"), "salts").cast("int").alias("salt")
    sides = [
        held.join(times, "part").select(
            "part", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(False).alias("query"), "node", "owner", "body"
        ),
        queries.join(times, "part").select("part", one, F.lit(True).alias("query"), "node", F.lit(None).cast("long").alias("owner"), "body"),
    ]
    met = sides[0].unionByName(sides[1]).repartition("part", "salt").sortWithinPartitions("part", "salt", "query")
    return met.mapInArrow(lambda batches: work(_runs(batches, 2)), schema)


def _least_shared(n: str, size: str, percent: int) -> str:
    """SQL: how many prefix tokens two similar sets of ``n`` and ``size`` share at least, and one less.

    Similar sets share o = percent (n + size) / (100 + percent) tokens. A prefix has what is
    beyond percent n of a set, and one; so it is longer than these sets need by o - percent n,
    and prefixes that are longer by l share l tokens more. One less, for the rounding.
    """
    share = f"ceil({percent}D * ({n} + {size}) / {100 + percent})"
    return f"{share} - ceil({percent}D * greatest({n}, {size}) / 100)"


def _candidates(placed: DataFrame, prefixes: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """The matrix (a row per token and group), and the queries (node, part) that it names.

    The node of the smaller class queries the groups of the larger one.
    """
    rows = prefixes.select("token", "node").join(placed, "node")
    owners = rows.groupBy("token").agg(F.min("owner").alias("low"), F.max("owner").alias("high")).where("low <> high")
    rows = stored(rows.join(owners.select("token"), "token", "left_semi"), "prefixes")
    matrix = stored(
        rows.groupBy("token", "part", "owner", "size").agg(F.min("n").alias("least"), F.max("n").alias("most")), "matrix"
    )
    theirs = matrix.withColumnsRenamed({"part": "group", "owner": "other", "size": "larger"})
    met = rows.join(theirs, "token").where(
        F.expr("owner <> other and (size < larger or size = larger and owner < other)")
        & F.expr(f"{percent}L * least <= 100L * n and {percent}L * n <= 100L * most")
    )
    counted = met.groupBy("node", "n", "group").agg(
        F.count("*").alias("shared"), F.min("least").alias("least"), F.max("most").alias("most")
    )
    # Sizes of members with such a token that could be similar; the bound is least at an end.
    low, high = f"greatest(least, ceil({percent}D * n / 100))", f"least(most, floor(n * 100D / {percent}))"
    bound = f"least({_least_shared('n', 'low', percent)}, {_least_shared('n', 'high', percent)})"
    able = counted.withColumns({"low": F.expr(low), "high": F.expr(high)}).where(f"low <= high and shared >= {bound}")
    return matrix, able.select("node", F.col("group").alias("part"))


def links(
    docs: DataFrame,
    text: str = "text",
    shingle: int = 4,
    percent: int = 85,
    group_sets: int = 256,
    group_tokens: int = 1 << 19,
    group_queries: int = 2048,
    frequent: int = 1 << 18,
) -> DataFrame:
    """Edges (a, b) between nodes that connect all that the links connect."""
    known = frequent_tokens(docs, text, shingle, frequent)
    prefixes = stored(_prefixes(docs, text, shingle, percent, known), "prefixes")
    live = prefixes.groupBy("node").agg(F.first("n").alias("n"), F.first("least").alias("least"))
    grouped = stored(_cut(stored(live, "nodes"), "least", 0, group_sets, group_tokens), "groups")
    cut_again = F.xxhash64("least", F.pmod(F.xxhash64("node", F.lit(1)), "cuts"), F.lit(1))
    # A part for what is alone in its group as well, which marks it as live.
    live = grouped.withColumn("again", F.when(F.col("cuts") > 1, cut_again))
    texts = stored(_texts(docs, text, shingle, live), "texts")
    together = grouped.groupBy("part").agg(F.count("*").alias("sets")).where("sets > 1").select("part")
    near = stored(_join_groups(texts.join(_checked(stored(together, "parts")), "part", "left_semi"), shingle, percent), "edges")
    again = texts.where("again is not null").drop("part").withColumnRenamed("again", "part")
    near = near.unionByName(stored(_join_groups(again, shingle, percent), "edges"))
    stars = components(near)
    for turn in (1, 2):
        hashed = texts.select("node", "n", F.col(f"hash{turn}").alias("least")).join(stars, "node", "left")
        hashed = hashed.withColumn("class", F.coalesce("component", "node"))
        several = hashed.groupBy("least").agg(F.min("class").alias("low"), F.max("class").alias("high")).where("low <> high")
        mixed = hashed.join(several.select("least"), "least", "left_semi").select("node", "n", "least")
        parts = stored(_cut(mixed, "least", 2 + turn, group_sets, group_tokens).select("node", "part"), "parts")
        if not parts.isEmpty():
            found = _join_groups(texts.drop("part").join(_checked(parts), "node"), shingle, percent)
            near = near.unionByName(stored(found, "edges"))
            stars = components(near)

    # The groups of the matrix: classes cut into parts, and what is still single.
    classed = grouped.select("node", "n", F.col("part").alias("single")).join(stars, "node", "left")
    classed = classed.withColumn("class", F.coalesce("component", "node")).drop("component")
    cut = _cut(classed, "class", 2, group_sets, group_tokens)
    alone, band = F.col("together") == 1, F.floor(F.log("n") / math.log(_BAND))
    placed = stored(
        cut.select(
            "node",
            "n",
            F.col("together").alias("size"),
            F.when(alone, F.col("single")).otherwise(F.col("class")).alias("owner"),
            F.xxhash64(F.when(alone, F.col("single")).otherwise(F.col("part")), band).alias("part"),
            "class",
        ),
        "placed",
    )
    _, asked = _candidates(placed, prefixes, percent)
    asked = stored(asked, "queries")
    if asked.isEmpty():
        return near
    wanted = asked.select("part").distinct()
    members = stored(placed.select("node", "part", F.col("class").alias("owner")).join(wanted, "part", "left_semi"), "members")
    needed_nodes = stored(asked.select("node").unionByName(members.select("node")).distinct(), "needed")
    texts = stored(texts.select("node", "body").join(_checked(needed_nodes), "node", "left_semi"), "texts")
    unions = stored(_unions(members.select("node", "part"), texts, shingle), "unions")
    bodies = unions.select("part", F.lit(None).cast("long").alias("node"), F.col("least").cast("long").alias("owner"), F.col("tokens").alias("body"))

    def bounded(groups: Iterator) -> Iterator[pa.RecordBatch]:
        """Queries whose overlap with the union allows a link with some member."""
        for (part, _), rows in groups:
            union, least, open_ = None, 0, []
            for _, _, query, node, owner, body in rows:
                if not query:
                    union, least = np.frombuffer(body, np.uint64), owner
                    continue
                tokens = _unpacked_set(body, shingle)
                n = len(tokens)
                at = np.minimum(np.searchsorted(union, tokens), len(union) - 1)
                overlap = int((union[at] == tokens).sum())
                # A member has max(least, n percent) tokens or more, and shares this part of both.
                if (100 + percent) * overlap >= percent * (n + max(least, needed(n, percent))):
                    open_.append(node)
            if open_:
                columns = [pa.array(open_, pa.int64()), pa.array([part] * len(open_), pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["node", "part"])

    opened = stored(_meet(bodies, asked.join(texts, "node"), bounded, "node long, part long", group_queries), "opened")

    def compare(groups: Iterator) -> Iterator[pa.RecordBatch]:
        """A link of each query with each class of an opened group."""
        for _, rows in groups:
            nodes, owners, sets, index, found = [], [], [], None, []
            for _, _, query, node, owner, body in rows:
                if not query:
                    nodes.append(node)
                    owners.append(owner)
                    sets.append(_unpacked_set(body, shingle))
                    continue
                index = index or Index(sets)
                tokens = _unpacked_set(body, shingle)
                near_ = np.flatnonzero(similar(index.overlaps(tokens), len(tokens), index.sizes, percent))
                _, first = np.unique(np.array(owners)[near_], return_index=True)
                found += [(node, nodes[i]) for i in near_[first].tolist()]
            if found:
                yield _edges(found)

    shown = members.join(opened.select("part").distinct(), "part", "left_semi").join(texts, "node")
    return near.unionByName(stored(_meet(shown, opened.join(texts, "node"), compare, _EDGES, group_queries), "edges"))


def classes(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 4, percent: int = 85, **settings) -> DataFrame:
    """key, n_shingles and component_id (the least key of the class) of every row of ``docs``.

    ``settings`` are those of ``links``.
    """
    rows = stored(_nodes(docs, key, text, shingle), "sets")
    stars = components(links(docs, text, shingle, percent, **settings))
    nodes = rows.where("n > 0").groupBy("node").agg(F.min("key").alias("least"))
    member = nodes.join(stars, "node", "left").withColumn("class", F.coalesce("component", "node"))
    name = member.groupBy("class").agg(F.min("least").alias("component_id"))
    named = member.join(name, "class").select("node", "component_id")
    # One row per node on the right, so Spark may split the rows of a hot node.
    return rows.join(named, "node", "left").select(
        F.col("key").alias(key),
        F.col("n").cast("long").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("key")).alias("component_id"),
    )
