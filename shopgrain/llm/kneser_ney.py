"""Interpolated modified Kneser-Ney model, counted in Spark, scored from mapped arrays.

The order is any from 2 on. Counting has a shuffle for the words, one for the n-grams of
each length and one for the continuations of each, all of sorted arrays and not of rows: a
task counts its own share of the text, cuts the sorted keys into shards, and sends one
packed array per shard.

1. Words, by 64-bit hash. A shard is a range of hashes; the sorted shards end to end are
   the vocabulary, and the id of a word is its place in it.
2. N-grams, from pairs up to the order: the id of the history times 2^b plus the id of the
   word, where b bits hold a word and the id of a history is its word or the place of its
   n-gram in the sorted shards of the length before. Shards are ranges of these keys with
   about ``shard_tokens`` tokens each; a frequent history is cut into several ranges of its
   followers, so no shard grows with one word.
3. Continuations, from the longest n-grams down: how many different words an n-gram
   follows, laid out as its shard. They take the place of the counts below the order.

Every shard is written once as flat sorted arrays below the shared folder, and a row of
figures about it (one per shard) goes to the driver. Workers map the arrays into memory
and search them; a shared folder that is no mounted file system is copied to an unlinked
file first. The arrays grow with the corpus and no count is pruned. Figures of a history
are stored where it has more than ``FEW`` followers and else added up when asked for.

P(w | h) = max(c(hw) - D(c), 0) / c(h) + g(h) P'(w | h'), where P' is the distribution of
continuations after the history without its first word, discounted in turn and in the end
mixed with 1 / (V + 1). Discounts for counts 1, 2 and 3+ come from the counts of counts of
each length. A text starts with as many starts as a history has words; its end is a word.

Nulls: a null or empty text is its end alone. Rows of a null id are scored; whether they
are learned from is the caller's choice of training rows. Copies count as often as they
occur. Extra columns stay. With no training rows every word is unknown: V and N are 0 and
a text scores 0 per token (log10 of 1 / (V + 1)).
"""

from __future__ import annotations

import gc
import mmap
import os
import tempfile
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from shopgrain.session import work_folder

END = b""  # no word is empty, so this stands for the end of a text
FEW = 8
SHARDS = "shard int, keys binary, counts binary"


# --- packed arrays -------------------------------------------------------------------


def pack(values: np.ndarray) -> bytes:
    """Sorted unsigned integers: differences, byte by byte from the lowest, compressed."""
    steps = np.diff(values.astype(np.uint64), prepend=np.uint64(0))
    return zstandard.compress(steps.view(np.uint8).reshape(-1, 8).T.tobytes(), 1)


def unpack(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).ravel(), dtype=np.uint64)


def pack_counts(counts: np.ndarray) -> bytes:
    return zstandard.compress(counts.astype(np.uint64).view(np.uint8).reshape(-1, 8).T.tobytes(), 1)


def unpack_counts(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view(np.uint64).ravel().astype(np.int64)


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, with their counts added up."""
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


def shard_rows(keys: np.ndarray, counts: np.ndarray, bounds: np.ndarray) -> Iterator[pa.RecordBatch]:
    """One packed row per shard; ``bounds`` are the first keys of the shards after the first."""
    cuts = [0, *np.searchsorted(keys, bounds).tolist(), len(keys)]
    for shard, (a, b) in enumerate(zip(cuts, cuts[1:])):
        if a < b:
            yield pa.RecordBatch.from_pydict(
                {
                    "shard": pa.array([shard], pa.int32()),
                    "keys": pa.array([pack(keys[a:b])], pa.binary()),
                    "counts": pa.array([pack_counts(counts[a:b])], pa.binary()),
                }
            )


def merged(batches: Iterator[pa.RecordBatch], room: int = 1 << 22) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(shard, keys, counts) of rows that stand in order of their shard.

    Arrays are added up whenever ``room`` keys wait, so memory follows the distinct keys
    of one shard.
    """
    held: list[tuple[np.ndarray, np.ndarray]] = []
    now, waiting = None, 0

    def add_up() -> tuple[np.ndarray, np.ndarray]:
        return summed(np.concatenate([k for k, _ in held]), np.concatenate([c for _, c in held]))

    for batch in batches:
        for shard, keys, counts in zip(*(batch.column(n).to_pylist() for n in ("shard", "keys", "counts"))):
            if shard != now and held:
                yield now, *add_up()
                held, waiting = [], 0
            now = shard
            held.append((unpack(keys), unpack_counts(counts)))
            waiting += len(held[-1][0])
            if waiting > room and len(held) > 1:
                held, waiting = [add_up()], 0
    if held:
        yield now, *add_up()


def let_go(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of plans that nothing refers to any more.

    It does so after a collection in the driver, which may be long in coming there.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def by_shard(rows: DataFrame, shards: int) -> DataFrame:
    """One shard to a task."""
    return rows.repartitionById(max(shards, 1), "shard")


# --- files ---------------------------------------------------------------------------


def write_array(folder: str, name: str, values: np.ndarray) -> str:
    """A new file; its name is told only by a task that ends well, so a retry does no harm."""
    fs, path = pafs.FileSystem.from_uri(folder)
    fs.create_dir(path, recursive=True)
    file = f"{name}-{uuid.uuid4().hex}"
    with fs.open_output_stream(f"{path}/{file}") as out:
        out.write(np.ascontiguousarray(values).tobytes())
    return file


def map_array(folder: str, file: str, dtype: str) -> np.ndarray:
    fs, path = pafs.FileSystem.from_uri(folder)
    path = f"{path}/{file}"
    if isinstance(fs, pafs.LocalFileSystem):
        return np.asarray(np.memmap(path, dtype, "r")) if os.path.getsize(path) else np.empty(0, dtype)
    with tempfile.TemporaryFile() as local, fs.open_input_stream(path) as source:
        while data := source.read(8 << 20):
            local.write(data)
        local.flush()
        if not local.tell():
            return np.empty(0, dtype)
        return np.frombuffer(mmap.mmap(local.fileno(), 0, access=mmap.ACCESS_READ), dtype)


class Counts:
    """Mapped counts: a byte each, and those from 255 on in a list of places and 64-bit values."""

    MOST = 255

    def __init__(self, folder: str, files: tuple[str, str] | None) -> None:
        small, large = files or ("", "")
        self.small = map_array(folder, small, "u1") if small else np.empty(0, "u1")
        self.places, self.values = (map_array(folder, large, "i8") if large else np.empty(0, "i8")).reshape(2, -1)

    def __len__(self) -> int:
        return len(self.small)

    def at(self, places: np.ndarray) -> np.ndarray:
        found = self.small[places].astype(np.int64)
        full = found == self.MOST
        if full.any():
            found[full] = self.values[np.searchsorted(self.places, places[full])]
        return found

    @classmethod
    def write(cls, folder: str, name: str, counts: np.ndarray) -> list[str]:
        large = np.flatnonzero(counts >= cls.MOST)
        small = write_array(folder, name, np.minimum(counts, cls.MOST).astype(np.uint8))
        return [small, write_array(folder, f"{name}-large", np.stack([large, counts[large]]).astype(np.int64)) if len(large) else ""]


# --- the model -----------------------------------------------------------------------


def discounts(counts_of_counts: list[int]) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts of counts 1, 2 and 3+, each within its count."""
    n1, n2, n3, n4 = (float(n) for n in counts_of_counts)
    if not n1 or not n2:
        return (0.5, 1.0, 1.5)
    y = n1 / (n1 + 2 * n2)
    d3 = 3 - 4 * y * n4 / n3 if n3 else 1.5
    return tuple(min(max(d, 0.0), k) for k, d in ((1.0, 1 - 2 * y * n2 / n1), (2.0, 2 - 3 * y * n3 / n2), (3.0, d3)))


@dataclass(frozen=True)
class Vocabulary:
    """Shards of the sorted word hashes: files, first id and first hash of each."""

    folder: str
    files: tuple[tuple[str, str, str], ...]  # hashes, counts, large counts
    starts: tuple[int, ...]
    size: int
    tokens: int
    bounds: np.ndarray


@dataclass(frozen=True)
class Level:
    """N-grams of one length: files and first place of each shard, first keys, discounts."""

    keys: tuple[str | None, ...]
    counts: tuple[tuple[str, str] | None, ...]  # with the large ones; below the order: of continuations
    histories: tuple[tuple[str, str] | None, ...]  # those of many followers, their figures
    starts: tuple[int, ...]
    size: int
    bounds: np.ndarray
    discounts: tuple[float, float, float] = (0, 0, 0)


@dataclass(frozen=True)
class Model:
    vocabulary: Vocabulary
    continuations: tuple[str | None, ...]  # file per vocabulary shard
    levels: tuple[Level, ...]  # from pairs on
    low: tuple[float, float, float]
    pairs: int
    low_mass: float

    @property
    def bits(self) -> int:
        return word_bits(self.vocabulary)


def word_bits(vocabulary: Vocabulary) -> int:
    return max(1, int(vocabulary.size - 1).bit_length())


class Words:
    """Ids of words in a worker, from the mapped hashes."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.v = vocabulary
        self.hashes = [map_array(vocabulary.folder, f[0], "u8") for f in vocabulary.files]
        self._counts: list[Counts] | None = None

    def find(self, words: pa.Array) -> np.ndarray:
        """Ids, -1 for unknown words."""
        hashes = xxh64(words)
        order = np.argsort(hashes)
        hashes = hashes[order]
        out = np.full(len(words), -1, np.int64)
        cuts = [0, *np.searchsorted(hashes, self.v.bounds).tolist(), len(hashes)]
        for table, start, a, b in zip(self.hashes, self.v.starts, cuts, cuts[1:]):
            if a < b and len(table):
                at = np.minimum(np.searchsorted(table, hashes[a:b]), len(table) - 1)
                out[order[a:b]] = np.where(table[at] == hashes[a:b], at + start, -1)
        return out

    def end(self) -> int:
        return int(self.find(pa.array([END]))[0])

    def pick(self, ids: np.ndarray, tables: list) -> np.ndarray:
        """Values of sorted ids (-1: 0) from arrays that are laid out as the vocabulary shards."""
        out = np.zeros(len(ids), np.int64)
        cuts = np.searchsorted(ids, [*self.v.starts, self.v.size])
        for table, start, a, b in zip(tables, self.v.starts, cuts, cuts[1:]):
            if a < b and len(table):
                at = ids[a:b] - start
                out[a:b] = table.at(at) if isinstance(table, Counts) else table[at]
        return out

    def counts(self, ids: np.ndarray) -> np.ndarray:
        if self._counts is None:
            self._counts = [Counts(self.v.folder, f[1:]) for f in self.v.files]
        return self.pick(ids, self._counts)


def strips(texts: pa.Array, room: int = 4 << 20) -> Iterator[pa.Array]:
    """The texts in runs of about ``room`` bytes; a longer text is a run of its own."""
    first = held = 0
    for n, size in enumerate(pc.fill_null(pc.binary_length(texts), 0).to_pylist()):
        if n > first and held + size > room:
            yield texts.slice(first, n - first)
            first, held = n, 0
        held += size
    if first < len(texts):
        yield texts.slice(first)


def tokens_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct tokens of binary texts, the place of each token there, and where each text starts.

    Words are ``[^\\x20\\x09-\\x0D]+``, A-Z in lower case; each text is closed by its end. The
    kernels for ASCII look at single bytes, so the texts need not be UTF-8.
    """
    # Behind a space at the end comes the empty string, which is the end of the text. The
    # join comes first: ``ascii_lower`` loses bytes where the first offset is not 0.
    closed = pc.binary_join_element_wise(pc.fill_null(texts.cast(pa.binary()), b"").view(pa.string()), " ", "")
    parts = pc.ascii_split_whitespace(pc.ascii_lower(closed))
    found = parts.flatten().dictionary_encode()
    at = found.indices.to_numpy()
    n = np.diff(parts.offsets.to_numpy())
    last = np.cumsum(n) - 1
    # Before white space at the start is one, too, which is no token.
    keep = (pc.binary_length(found.dictionary).to_numpy() > 0)[at]
    keep[last] = True
    if not keep.all():
        n = np.add.reduceat(keep, last - n + 1, dtype=np.int64)
        at = at[keep]
    return found.dictionary, at, np.cumsum(n) - n


_P1, _P2, _P3, _P4, _P5 = (
    np.uint64(p)
    for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5)
)


def _turned(x: np.ndarray, by: int) -> np.ndarray:
    return x << np.uint64(by) | x >> np.uint64(64 - by)


def xxh64(words: pa.Array) -> np.ndarray:
    """The 64-bit xxHash of each word, as the library gives it, for all words at once.

    Words of 32 bytes and more, which are mixed in another way, are left to the library.
    """
    ends = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
    at, sizes = ends[:-1].copy(), np.diff(ends)
    data = np.zeros(int(ends[-1]) + 8, np.uint8)  # so 8 bytes can be read anywhere
    data[: ends[-1]] = np.frombuffer(words.buffers()[2] or b"", np.uint8)[: ends[-1]]
    eights, fours = (np.ndarray(len(data) - 7, t, data, strides=(1,)) for t in ("<u8", "<u4"))
    out = _P5 + sizes.astype(np.uint64)
    rows = np.flatnonzero((sizes >= 8) & (sizes < 32))
    while len(rows):
        lane = _turned(eights[at[rows]] * _P2, 31) * _P1
        out[rows] = _turned(out[rows] ^ lane, 27) * _P1 + _P4
        at[rows] += 8
        rows = rows[ends[1:][rows] - at[rows] >= 8]
    rows = np.flatnonzero((sizes & 4 > 0) & (sizes < 32))
    out[rows] = _turned(out[rows] ^ fours[at[rows]] * _P1, 23) * _P2 + _P3
    at[rows] += 4
    for k in range(1, 4):
        rows = np.flatnonzero((sizes & 3 >= k) & (sizes < 32))
        out[rows] = _turned(out[rows] ^ data[at[rows]] * _P5, 11) * _P1
        at[rows] += 1
    out = (out ^ out >> np.uint64(33)) * _P2
    out = (out ^ out >> np.uint64(29)) * _P3
    out ^= out >> np.uint64(32)
    for row in np.flatnonzero(sizes >= 32).tolist():
        out[row] = xxhash.xxh64_intdigest(data[ends[row] : ends[row + 1]])
    return out


class Keys:
    """N-gram keys of tokens in a worker, from the mapped shards of the shorter n-grams."""

    def __init__(self, vocabulary: Vocabulary, levels: tuple[Level, ...], end_id: int) -> None:
        self.folder, self.levels, self.end_id = vocabulary.folder, levels, end_id
        self.bits = np.uint64(word_bits(vocabulary))
        self._maps: dict[str, np.ndarray] = {}
        self._counts: dict[tuple[str, str] | None, Counts] = {}

    def counts(self, files: tuple[str, str] | None) -> Counts:
        if files not in self._counts:
            self._counts[files] = Counts(self.folder, files)
        return self._counts[files]

    def array(self, file: str | None, dtype: str) -> np.ndarray:
        if file is None:
            return np.empty(0, dtype)
        if file not in self._maps:
            self._maps[file] = map_array(self.folder, file, dtype)
        return self._maps[file]

    def places(self, level: Level, keys: np.ndarray) -> np.ndarray:
        """Places of sorted keys, -1 for unknown ones."""
        out = np.full(len(keys), -1, np.int64)
        cuts = [0, *np.searchsorted(keys, level.bounds).tolist(), len(keys)]
        for n, (a, b) in enumerate(zip(cuts, cuts[1:])):
            if a < b and len(table := self.array(level.keys[n], "u8")):
                at = np.minimum(np.searchsorted(table, keys[a:b]), len(table) - 1)
                out[a:b] = np.where(table[at] == keys[a:b], at + level.starts[n], -1)
        return out

    def histories(self, ids: np.ndarray, starts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each length: id of the history of each token (-1: unknown), key (where both are known).

        The history of starts alone is the id of the end in pairs, as no text goes on after
        its end, and else the number of n-grams of the length before.
        """
        back = np.arange(len(ids)) - np.repeat(starts, np.diff(np.append(starts, len(ids))))
        history = np.concatenate([[self.end_id], ids[:-1]])
        history[back == 0] = self.end_id
        for n in range(len(self.levels) + 1):
            known = (history >= 0) & (ids >= 0)
            key = np.zeros(len(ids), np.uint64)
            key[known] = (history[known].astype(np.uint64) << self.bits) | ids[known].astype(np.uint64)
            yield history, key
            if n < len(self.levels):
                level = self.levels[n]
                place = np.full(len(ids), -1, np.int64)
                distinct, where = np.unique(key[known], return_inverse=True)
                place[known] = self.places(level, distinct)[where]
                history = np.concatenate([[level.size], place[:-1]])
                history[back == 0] = level.size


def train(docs: DataFrame, text: str = "text", shard_tokens: int = 4_000_000, order: int = 2) -> Model:
    """The model of all rows of ``docs``; its arrays are below the shared folder."""
    if order < 2:
        raise ValueError("the order is 2 at least")
    spark = docs.sparkSession
    folder = work_folder(spark, "kneser-ney")
    shards = int(spark.conf.get("spark.sql.shuffle.partitions"))
    texts = docs.select(F.col(text).cast("binary").alias("text"))
    bounds = np.array([(i << 64) // shards for i in range(1, shards)], np.uint64)

    # 1. Words.
    def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        waiting = 0
        for batch in batches:
            for run in strips(batch.column(0)):
                words, at, _ = tokens_of(run)
                held.append((xxh64(words), np.bincount(at)))
                waiting += len(held[-1][0])
                if waiting > 2_000_000:
                    held = [summed(*(np.concatenate(x) for x in zip(*held)))]
                    waiting = len(held[0][0])
                    if waiting > 500_000:
                        yield from shard_rows(*held[0], bounds)
                        held, waiting = [], 0
        if held:
            yield from shard_rows(*summed(*(np.concatenate(x) for x in zip(*held))), bounds)

    def write_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, keys, counts in merged(batches):
            # Where a new bigram shard starts: after each shard_tokens tokens of histories.
            passed = np.cumsum(counts)
            cuts = np.searchsorted(passed, np.arange(shard_tokens, passed[-1], shard_tokens))
            at, times = np.unique(cuts, return_counts=True)
            yield _figures(
                shard=shard,
                files=[write_array(folder, "words", keys), *Counts.write(folder, "counts", counts)],
                figures=[len(keys), int(counts.sum()), *np.stack([at, times], 1).ravel().tolist()],
            )

    told = by_shard(texts.mapInArrow(count_words, SHARDS), shards).mapInArrow(write_words, FIGURES).collect()
    by_number = {r["shard"]: r for r in told}
    files, starts, cuts, size, tokens = [], [], [], 0, 0
    for s in range(shards):
        starts.append(size)
        r = by_number.get(s)
        if r is None:
            files.append(("", "", ""))
            continue
        files.append(tuple(r["files"]))
        n, t, *more = r["figures"]
        cuts.append((size, 0, 1))
        # A history that holds several cuts is divided by its followers.
        cuts += [(size + at, k, times) for at, times in zip(more[::2], more[1::2]) for k in range(times)]
        size, tokens = size + n, tokens + t
    kept = [s for s in range(shards) if files[s][0]]
    if size >= 1 << 32:
        raise ValueError("more than 2^32 words")
    vocabulary = Vocabulary(
        folder,
        tuple(files[s] for s in kept),
        tuple(starts[s] for s in kept),
        size,
        tokens,
        np.array([bounds[s - 1] for s in kept[1:]], np.uint64),
    )
    if not size:
        return Model(vocabulary, (), (), (0, 0, 0), 0, 1.0)
    # A vocabulary shard's ids are one range, so word ids can be cut like hashes.
    word_cuts = np.array(vocabulary.starts[1:], np.uint64)
    bits = word_bits(vocabulary)
    mask = np.uint64((1 << bits) - 1)

    def cut_keys(wanted: list[tuple[int, int, int]]) -> np.ndarray:
        return np.array(sorted({(h << bits) | ((k << bits) // times) for h, k, times in wanted} - {0}), np.uint64)

    # 2. N-grams, a length at a time.
    levels: tuple[Level, ...] = ()
    for length in range(2, order + 1):
        shorter, bounds, longest = levels, cut_keys(cuts), length == order

        def count_grams(batches: Iterator[pa.RecordBatch], shorter=shorter, bounds=bounds) -> Iterator[pa.RecordBatch]:
            words = Words(vocabulary)
            keys_of = Keys(vocabulary, shorter, words.end())
            held, waiting = [], 0

            def flush() -> Iterator[pa.RecordBatch]:
                keys, counts = np.unique(np.concatenate(held), return_counts=True)
                yield from shard_rows(keys, counts, bounds)

            for batch in batches:
                for run in strips(batch.column(0)):
                    distinct, at, starts = tokens_of(run)
                    *_, (_, keys) = keys_of.histories(words.find(distinct)[at], starts)
                    held.append(keys)
                    waiting += len(keys)
                    if waiting > 6_000_000:
                        yield from flush()
                        held, waiting = [], 0
            if held:
                yield from flush()

        def write_grams(batches: Iterator[pa.RecordBatch], longest=longest) -> Iterator[pa.RecordBatch]:
            for shard, keys, counts in merged(batches):
                files, more = [write_array(folder, "grams", keys)], []
                if longest:
                    files += write_counts(folder, keys, counts, bits)
                else:
                    passed = np.cumsum(counts)
                    at = np.searchsorted(passed, np.arange(shard_tokens, passed[-1], shard_tokens))
                    more = np.stack(np.unique(at, return_counts=True), 1).ravel().tolist()
                yield _figures(shard, files, [len(keys), *_times(counts), *more])

        rows = by_shard(texts.mapInArrow(count_grams, SHARDS), len(bounds) + 1)
        told = {r["shard"]: r for r in rows.mapInArrow(write_grams, FIGURES).collect()}
        del rows
        let_go(spark)
        shards_of = range(len(bounds) + 1)
        sizes = [told[n]["figures"][0] if n in told else 0 for n in shards_of]
        first = [0, *np.cumsum(sizes).tolist()][: len(sizes)]
        if not longest:
            if sum(sizes) >= 1 << (64 - bits):
                raise ValueError(f"too many {length}-grams for 64-bit keys")
            cuts = [(first[n], 0, 1) for n in told]
            for n, r in told.items():
                more = r["figures"][6:]
                cuts += [(first[n] + at, k, times) for at, times in zip(more[::2], more[1::2]) for k in range(times)]
            cuts.append((sum(sizes), 0, 1))
        files = [told[n]["files"] if n in told else None for n in shards_of]
        levels += (_level([f and f[0] for f in files], [f and f[1:] for f in files], first, sum(sizes), bounds),)
        if longest:
            high = discounts([sum(r["figures"][k] for r in told.values()) for k in (1, 2, 3, 4)])
            levels = (*levels[:-1], replace(levels[-1], discounts=high))

    # 3. Continuations: the files of step 2 are read by name, one task per file.
    for n in range(len(levels) - 1, -1, -1):
        level, below = levels[n], levels[n - 1] if n else None
        names = spark.createDataFrame([(f,) for f in level.keys if f], "keys string")

        def send(batches: Iterator[pa.RecordBatch], n=n, below=below) -> Iterator[pa.RecordBatch]:
            keys_of = Keys(vocabulary, levels, Words(vocabulary).end())
            for batch in batches:
                for file in batch.column(0).to_pylist():
                    keys = np.asarray(map_array(folder, file, "u8"))
                    if below is None:
                        yield from shard_rows(*np.unique(keys & mask, return_counts=True), word_cuts)
                        continue
                    # The last words of a history: of starts alone, the start again.
                    history, back = np.unique(keys >> np.uint64(bits), return_inverse=True)
                    yield from shard_rows(*np.unique(last_of(keys_of, n, history)[back] << np.uint64(bits) | keys & mask, return_counts=True), below.bounds)

        def write_continuations(batches: Iterator[pa.RecordBatch], below=below) -> Iterator[pa.RecordBatch]:
            for shard, keys, counts in merged(batches):
                if below is None:
                    dense = np.zeros(ends[shard] - vocabulary.starts[shard], np.uint32)
                    dense[keys.astype(np.int64) - vocabulary.starts[shard]] = counts
                    yield _figures(shard, [write_array(folder, "continuations", dense)], _times(counts))
                else:  # every n-gram ends a longer one, so the keys are those of the shard
                    yield _figures(shard, write_counts(folder, keys, counts, bits), _times(counts))

        ends = (*vocabulary.starts[1:], size)
        parts = len(vocabulary.files) if below is None else len(below.bounds) + 1
        spread = names.repartition(max(names.count(), 1)).mapInArrow(send, SHARDS)
        told = {r["shard"]: r for r in by_shard(spread, parts).mapInArrow(write_continuations, FIGURES).collect()}
        del spread
        let_go(spark)
        sums = [sum(r["figures"][k] for r in told.values()) for k in range(5)]
        found = [told[k]["files"] if k in told else None for k in range(parts)]
        if below is not None:
            made = _level(list(below.keys), found, below.starts, below.size, below.bounds)
            levels = (*levels[: n - 1], replace(made, discounts=discounts(sums[:4])), *levels[n:])
    low = discounts(sums[:4])
    total = levels[0].size
    mass = (low[0] * sums[0] + low[1] * sums[1] + low[2] * sums[4]) / total
    return Model(vocabulary, tuple(f and f[0] for f in found), levels, low, total, mass)


def _level(keys: list, files: list, starts, size: int, bounds: np.ndarray) -> Level:
    """``files``: counts, histories and their figures of each shard, if it has them."""
    counts = tuple(tuple(f[:2]) if f else None for f in files)
    return Level(tuple(keys), counts, tuple(tuple(f[2:]) if f else None for f in files), tuple(starts), size, bounds)


def _times(counts: np.ndarray) -> list[int]:
    """How many are 1, 2, 3, 4, and 3 or more."""
    return [int((counts == k).sum()) for k in (1, 2, 3, 4)] + [int((counts >= 3).sum())]


def last_of(keys_of: Keys, n: int, history: np.ndarray) -> np.ndarray:
    """Ids of sorted histories of level ``n`` (1 at least) without their first word."""
    level = keys_of.levels[n - 1]
    bits, mask = keys_of.bits, (np.uint64(1) << keys_of.bits) - np.uint64(1)
    keys = np.zeros(len(history), np.uint64)
    cuts = np.searchsorted(history, np.array([*level.starts, level.size], np.uint64))
    for s, (a, b) in enumerate(zip(cuts, cuts[1:])):
        if a < b:
            keys[a:b] = keys_of.array(level.keys[s], "u8")[history[a:b].astype(np.int64) - level.starts[s]]
    starts_only = history == np.uint64(level.size)
    if n == 1:
        out = keys & mask
        out[starts_only] = np.uint64(keys_of.end_id)
        return out
    first, back = np.unique(keys[~starts_only] >> bits, return_inverse=True)
    shorter = (last_of(keys_of, n - 1, first)[back] << bits) | (keys[~starts_only] & mask)
    distinct, back = np.unique(shorter, return_inverse=True)
    out = np.full(len(history), keys_of.levels[n - 2].size, np.uint64)
    out[~starts_only] = keys_of.places(keys_of.levels[n - 2], distinct)[back].astype(np.uint64)
    return out


def write_counts(folder: str, keys: np.ndarray, counts: np.ndarray, bits: int) -> list[str]:
    """Files of the counts, and of the histories with more than FEW followers and their figures."""
    history = keys >> np.uint64(bits)
    first = np.flatnonzero(np.concatenate([[True], history[1:] != history[:-1]]))
    many = np.diff(np.append(first, len(keys))) > FEW
    figures = np.stack([np.add.reduceat(x, first, dtype=np.int64)[many] for x in (counts, counts == 1, counts == 2, counts >= 3)], 1)
    return [
        *Counts.write(folder, "counts", counts),
        write_array(folder, "histories", history[first][many]),
        write_array(folder, "history-figures", figures.astype(np.uint64)),
    ]


FIGURES = "shard int, files array<string>, figures array<long>"


def _figures(shard: int, files: list[str], figures: list[int]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict(
        {
            "shard": pa.array([shard], pa.int32()),
            "files": pa.array([files], pa.list_(pa.string())),
            "figures": pa.array([figures], pa.list_(pa.int64())),
        }
    )


class Scorer:
    """The mapped model in a worker."""

    def __init__(self, model: Model) -> None:
        self.m, self.words = model, Words(model.vocabulary)
        folder = model.vocabulary.folder
        self.follows = [map_array(folder, f, "u4") if f else np.empty(0, "u4") for f in model.continuations]
        self.end_id = self.words.end()
        self.keys = Keys(model.vocabulary, model.levels[:-1], self.end_id)

    def _low(self, ids: np.ndarray) -> np.ndarray:
        m, c = self.m, self.words.pick(ids, self.follows)
        d = np.array([0.0, *m.low])[np.minimum(c, 3)]
        return (c - d) / m.pairs + m.low_mass / (m.vocabulary.size + 1)

    def _counts(self, level: Level, keys: np.ndarray, places: np.ndarray) -> np.ndarray:
        """Counts of sorted keys that are at these places (-1: nowhere)."""
        out = np.zeros(len(keys), np.int64)
        cuts = [0, *np.searchsorted(keys, level.bounds).tolist(), len(keys)]
        for n, (a, b) in enumerate(zip(cuts, cuts[1:])):
            rows = a + np.flatnonzero(places[a:b] >= 0)
            if len(rows):
                out[rows] = self.keys.counts(level.counts[n]).at(places[rows] - level.starts[n])
        return out

    def _histories(self, level: Level, ids: np.ndarray) -> np.ndarray:
        """Sum of counts, and distinct followers by count 1, 2, 3+, of sorted history ids."""
        out = np.zeros((4, len(ids)), np.int64)
        ids = ids.astype(np.uint64)
        low = ids << self.keys.bits
        high = low | ((np.uint64(1) << self.keys.bits) - np.uint64(1))
        first = np.searchsorted(level.bounds, low, "right")
        last = np.searchsorted(level.bounds, high, "right")  # several, if divided
        # Both grow with the ids, so the histories of a shard are neighbours.
        shards = np.arange(len(level.keys))
        cuts = zip(np.searchsorted(last, shards).tolist(), np.searchsorted(first, shards, "right").tolist())
        for n, (a, b) in enumerate(cuts):
            if a < b and level.keys[n] is not None:
                out[:, a:b] += self._followers(level, n, ids[a:b], low[a:b])
        return out

    def _followers(self, level: Level, n: int, ids: np.ndarray, low: np.ndarray) -> np.ndarray:
        """The figures of sorted histories in one shard: followers are read one after the
        other as long as they are of the history, and looked up where they are many."""
        out = np.zeros((4, len(ids)), np.int64)
        table, counts = self.keys.array(level.keys[n], "u8"), self.keys.counts(level.counts[n])
        rows, at = np.arange(len(ids)), np.searchsorted(table, low)
        for k in range(FEW + 1):
            inside = at < len(table)
            if not inside.all():
                rows, at = rows[inside], at[inside]
            same = (table[at] >> self.keys.bits) == ids[rows]
            rows, at = rows[same], at[same]
            if not len(rows) or k == FEW:
                break
            c = counts.at(at)
            out[0, rows] += c
            out[np.minimum(c, 3), rows] += 1
            at = at + 1
        if len(rows):
            where = np.searchsorted(self.keys.array(level.histories[n][0], "u8"), ids[rows])
            out[:, rows] = self.keys.array(level.histories[n][1], "u8").reshape(-1, 4)[where].T
        return out

    def texts(self, texts: pa.Array) -> tuple[np.ndarray, ...]:
        """Per text: tokens, known tokens, unigram score, model score (log10)."""
        v = self.m.vocabulary
        words, at, starts = tokens_of(texts)
        seen, back = np.unique(self.words.find(words), return_inverse=True)
        at = back[at]
        counts = self.words.counts(seen)
        base = np.log10((counts + 0.5) / (v.tokens + 0.5 * (v.size + 1)))[at]
        chance = np.log10(self._chance(seen, at, starts)) if v.size else np.zeros(len(at))
        n = np.diff(np.append(starts, len(at)))
        known = np.add.reduceat((counts > 0)[at], starts, dtype=np.int64)
        return n, known, *(np.add.reduceat(x, starts) for x in (base, chance))

    def _chance(self, seen: np.ndarray, at: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Chance of each token, level by level: ``seen`` are the distinct words, ``at`` the
        tokens' places there. Distinct n-grams are searched once: their places are their
        counts' and, for the next level, the histories (-1 for unknown ones)."""
        ids, chance, bits = seen[at], self._low(seen)[at], self.keys.bits
        end = np.searchsorted(seen, self.end_id)  # every text has its end
        place = np.concatenate([[end], at[:-1]])
        place[starts] = end
        for n, level in enumerate(self.m.levels):
            known = seen >= 0
            figures = np.zeros((4, len(seen)), np.int64)
            figures[:, known] = self._histories(level, seen[known])
            total = np.maximum(figures[0], 1)
            mass = sum(d * f for d, f in zip(level.discounts, figures[1:]))
            left = np.where(figures[0] > 0, mass / total, 1.0)
            history = seen[place]
            both = (history >= 0) & (ids >= 0)
            keys = (history[both].astype(np.uint64) << bits) | ids[both].astype(np.uint64)
            distinct, back = np.unique(keys, return_inverse=True)
            found = self.keys.places(level, distinct)
            c = np.zeros(len(ids), np.int64)
            c[both] = self._counts(level, distinct, found)[back]
            d = np.array([0.0, *level.discounts])[np.minimum(c, 3)]
            chance = (c - d) / total[place] + left[place] * chance
            if n + 1 < len(self.m.levels):
                # Places grow with their keys, so they are in order already.
                there = found >= 0
                seen = np.concatenate([[-1], found[there], [level.size]])
                rank = np.where(there, np.cumsum(there), 0)
                own = np.zeros(len(ids), np.int64)
                own[both] = rank[back]
                place = np.concatenate([[len(seen) - 1], own[:-1]])
                place[starts] = len(seen) - 1
        return chance


_LOADED: dict[str, Scorer] = {}
OUT = ("n_tokens", "n_known", "train_tokens", "base_score", "score")


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` without the text, with token counts and log10 probabilities."""
    shared = docs.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, model))  # a row per shard
    kept = docs.drop(*OUT).withColumn(text, F.col(text).cast("binary"))
    at = kept.columns.index(text)
    types = [LongType(), LongType(), LongType(), DoubleType(), DoubleType()]
    own = [StructField(n, t) for n, t in zip(OUT, types)]
    schema = StructType([*(f for f in kept.schema.fields if f.name != text), *own])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, m = shared.value
        if name not in _LOADED:
            _LOADED.clear()
            _LOADED[name] = Scorer(m)
        scorer = _LOADED[name]
        for batch in batches:
            parts = [scorer.texts(run) for run in strips(batch.column(at))]
            n, known, base, chance = (np.concatenate(p) for p in zip(*parts)) if parts else [np.empty(0)] * 4
            made = [
                pa.array(n.astype(np.int64)),
                pa.array(known.astype(np.int64)),
                pa.array(np.full(len(n), m.vocabulary.tokens, np.int64)),
                pa.array(base.astype(float)),
                pa.array(chance.astype(float)),
            ]
            columns = [c for i, c in enumerate(batch.columns) if i != at]
            yield pa.RecordBatch.from_arrays([*columns, *made], names=schema.names)

    return kept.mapInArrow(run, schema)


def perplexity(scored: DataFrame) -> F.Column:
    """Perplexity per token of the rows of ``score``."""
    return F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens"))

