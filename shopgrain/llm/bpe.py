"""Byte-level BPE: a transducer lexicon for frequent chunks, exact merges for the rest.

A chunk is a word with its leading space and what clings to it, or a run of white space;
the words of the tokenizer (pre-tokens) never cross chunks. Chunks are counted over all
documents in Spark; the ``lexicon_chunks`` most frequent ones are encoded and compiled
into a minimal acyclic transducer: an automaton whose equal tails are shared, where every
arc adds a number and the sum along a chunk is its place in a packed table of ids. The
automaton and the table are flat arrays. They are broadcast as one blob (bounded by
``lexicon_chunks``), and each worker process maps them from an unlinked file, so no copy
lives on its heap and nothing is left behind. A chunk that is not in the lexicon is split
into words, which are merged exactly by the merge ranks of the tokenizer file, many words
in step; so the lexicon decides the speed and never the ids.

Each worker also remembers ``memory`` recent chunks and words, as texts repeat them; when
full, it starts anew. Texts are taken a few at a time, so a worker holds the ids of those
only.

The vocabulary file is a byte-level BPE file of the tokenizers library; its path is an
argument. The file's added tokens are cut out of the text first, as that library does.

Nulls: a null text is empty and has no ids; null ids decode to the empty text. Copies
are answered row by row. Extra columns stay; a column named like the output is replaced.
An empty table gives an empty lexicon and an empty result.
"""

from __future__ import annotations

import heapq
import json
import mmap
import re
import tempfile
import uuid
from array import array
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from shopgrain.llm.frequent import most_frequent

# Unicode White_Space, and the word pattern of the byte-level tokenizer.
_SPACE = r"\t-\r\x20\x85\xa0" + "".join(
    map(chr, [0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000])
)
_WORD = regex.compile(
    rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_SPACE}\p{{L}}\p{{N}}]+"
    rf"|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+"
)
# A chunk never ends inside a word, and words never cross chunks.
_CHUNK = re.compile(rf" ?[^{_SPACE}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")


def byte_alphabet() -> dict[str, int]:
    """Character of the vocabulary file -> byte.

    Printable Latin-1 characters stand for themselves; the other bytes follow from
    U+0100 on, in order.
    """
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


# A pair is its two ids in 24 bits each; a merge is its rank above the 24 bits of the new
# id, so the least one is the first.
_ID, _NONE = (1 << 24) - 1, 1 << 62


@dataclass(frozen=True)
class Vocabulary:
    """Ids of the bytes, merges as pair -> rank and new id, bytes of every id."""

    singles: tuple[int, ...]
    merges: dict[int, int]
    pieces: tuple[bytes, ...]
    added: dict[str, int]

    @classmethod
    def read(cls, path: str) -> Vocabulary:
        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        alphabet, ids = byte_alphabet(), data["model"]["vocab"]
        added = {t["content"]: t["id"] for t in data["added_tokens"]}
        size = max([*ids.values(), *added.values()]) + 1
        pieces = [b""] * size
        for token, i in ids.items():
            if token not in added:
                pieces[i] = bytes(alphabet[c] for c in token)
        for token, i in added.items():
            pieces[i] = token.encode()
        back = {b: c for c, b in alphabet.items()}
        merges = {}
        for rank, pair in enumerate(data["model"]["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            merges.setdefault(ids[left] << 24 | ids[right], rank << 24 | ids[left + right])
        return cls(tuple(ids[back[b]] for b in range(256)), merges, tuple(pieces), added)

    def encode(self, chunk: str) -> list[int]:
        """Ids of a chunk by merges alone."""
        return [i for word in _WORD.findall(chunk) for i in self.merge(word.encode())]

    def merge_all(self, words: list[bytes]) -> list[bytes]:
        """Packed ids of many words of at most ``LONG`` bytes, all merged in step.

        The symbols of all words stand in one array. In a round every word joins its
        leftmost pair of the lowest rank, which is what merging it alone does.
        """
        if not words:
            return []
        keys, values = self.table
        ids = np.array(self.singles, np.int64)[np.frombuffer(b"".join(words), np.uint8)]
        sizes = np.array([len(w) for w in words])
        word = np.repeat(np.arange(len(words)), sizes)

        def ranks(left: np.ndarray, right: np.ndarray) -> np.ndarray:
            pairs = left << 24 | right
            at = np.minimum(np.searchsorted(keys, pairs), len(keys) - 1)
            return np.where(keys[at] == pairs, values[at], _NONE)

        # The value of each symbol with the next one; the last of a word has none.
        found = np.append(ranks(ids[:-1], ids[1:]), _NONE)
        found[np.cumsum(sizes) - 1] = _NONE
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        while len(ids):
            first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            best = np.minimum.reduceat(found, first)
            size = np.diff(np.append(first, len(ids)))
            going = np.repeat(best != _NONE, size)
            if not going.all():
                parts.append((word[~going], ids[~going]))
                ids, word, found = ids[going], word[going], found[going]
                size, best = size[best != _NONE], best[best != _NONE]
                first = np.cumsum(size) - size
                if not len(ids):
                    break
            hits = np.flatnonzero(found == np.repeat(best, size))
            at = hits[np.concatenate([[True], word[hits[1:]] != word[hits[:-1]]])]
            ids[at] = found[at] & _ID
            keep = np.ones(len(ids), bool)
            keep[at + 1] = False
            found[at] = _NONE
            at -= np.arange(len(at))
            ids, word, found = ids[keep], word[keep], found[keep]
            right = at[_inner(word, at)]
            found[right] = ranks(ids[right], ids[right + 1])
            left = at[_inner(word, at - 1) & (at > 0)] - 1
            found[left] = ranks(ids[left], ids[left + 1])
        word = np.concatenate([w for w, _ in parts])
        order = np.argsort(word, kind="stable")
        flat = np.concatenate([i for _, i in parts])[order].astype(np.int32).tobytes()
        ends = (np.cumsum(np.bincount(word, minlength=len(words))) * 4).tolist()
        return [flat[a:b] for a, b in zip([0, *ends], ends)]

    @cached_property
    def table(self) -> tuple[np.ndarray, np.ndarray]:
        """The merges as sorted arrays."""
        keys = np.array(sorted(self.merges), np.int64)
        return keys, np.array([self.merges[k] for k in keys.tolist()], np.int64)

    def merge(self, word: bytes) -> list[int]:
        """Ids of one word: the pair of the lowest rank is joined, leftmost first."""
        ids = [self.singles[b] for b in word]
        return self._short(ids) if len(ids) <= LONG else self._long(ids)

    def _short(self, ids: list[int]) -> list[int]:
        get = self.merges.get
        found = [get(a << 24 | b, _NONE) for a, b in zip(ids, ids[1:])]
        while found:
            best = min(found)
            if best == _NONE:
                break
            i = found.index(best)
            ids[i : i + 2] = [best & _ID]
            del found[i]
            if i:
                found[i - 1] = get(ids[i - 1] << 24 | ids[i], _NONE)
            if i < len(found):
                found[i] = get(ids[i] << 24 | ids[i + 1], _NONE)
        return ids

    def _long(self, ids: list[int]) -> list[int]:
        """The same with a heap, for words of any length."""
        after = [*range(1, len(ids)), -1]
        before = list(range(-1, len(ids) - 1))
        heap: list[tuple[int, int, int, int]] = []

        def offer(i: int) -> None:
            if i >= 0 and after[i] >= 0:
                found = self.merges.get(ids[i] << 24 | ids[after[i]], _NONE)
                if found != _NONE:
                    heapq.heappush(heap, (found >> 24, i, ids[i], ids[after[i]]))

        for i in range(len(ids)):
            offer(i)
        while heap:
            _, i, left, right = heapq.heappop(heap)
            j = after[i]
            if ids[i] != left or j < 0 or ids[j] != right:
                continue
            ids[i] = self.merges[left << 24 | right] & _ID
            ids[j] = -1
            after[i] = after[j]
            if after[i] >= 0:
                before[after[i]] = i
            after[j] = -1
            offer(before[i])
            offer(i)
        return [i for i in ids if i >= 0]


# Bytes of a key that are looked up at once; bytes above which a word is merged by heap.
HEAD, LONG = 4, 48


def _inner(word: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Places whose next symbol is of the same word."""
    after = np.minimum(at + 1, len(word) - 1)
    return (after > at) & (word[np.maximum(at, 0)] == word[after])


def compile_lexicon(entries: dict[bytes, list[int]]) -> bytes:
    """A minimal acyclic transducer from keys to ids, as flat arrays in one blob.

    Built from the sorted keys: the tail that the next key does not share is frozen, and
    a frozen state that equals an earlier one is replaced by it. Arcs of a state stand
    together; each arc adds the number of keys that leave the state before it, so the sum
    of a path is the rank of its key.
    """
    ordered = sorted(entries)
    frozen: dict[tuple, int] = {}
    states: list[tuple[bool, tuple[tuple[int, int], ...]]] = []
    counts: list[int] = []
    open_path: list[list] = [[False, []]]

    def freeze(node: list) -> int:
        key = (node[0], tuple(node[1]))
        if key not in frozen:
            frozen[key] = len(states)
            states.append(key)
            counts.append(node[0] + sum(counts[t] for _, t in node[1]))
        return frozen[key]

    def close(depth: int, word: bytes) -> None:
        while len(open_path) > depth + 1:
            node = open_path.pop()
            open_path[-1][1].append((word[len(open_path) - 1], freeze(node)))

    last = b""
    for word in ordered:
        shared = next((i for i, (a, b) in enumerate(zip(last, word)) if a != b), min(len(last), len(word)))
        close(shared, last)
        open_path.extend([False, []] for _ in range(len(word) - shared))
        open_path[-1][0] = True
        last = word
    close(0, last)
    root = freeze(open_path[0])

    first, labels, targets, adds, final = [0], bytearray(), [], [], bytearray()
    for is_final, arcs in states:
        total = int(is_final)
        for label, target in arcs:
            labels.append(label)
            targets.append(target)
            adds.append(total)
            total += counts[target]
        first.append(len(labels))
        final.append(is_final)
    rows = [entries[k] for k in ordered]
    starts = np.cumsum([0, *map(len, rows)], dtype=np.int32)
    arrays = [
        np.array([root], np.int32),
        np.frombuffer(bytes(labels), np.uint8),
        np.frombuffer(bytes(final), np.uint8),
        np.array(first, np.int32),
        np.array(targets, np.int32),
        np.array(adds, np.int32),
        starts,
        np.array([i for r in rows for i in r], np.int32),
    ]
    head = np.array([x for a in arrays for x in (a.itemsize, a.size)], np.int32).tobytes()
    return head + b"".join(a.tobytes() + b"\0" * (-a.nbytes % 4) for a in arrays)


class Lexicon:
    """A compiled lexicon, mapped into memory."""

    def __init__(self, blob: bytes) -> None:
        # The file has no name once it is open; the mapping keeps its pages.
        with tempfile.TemporaryFile() as f:
            f.write(blob)
            f.flush()
            self._map = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        view, head = memoryview(self._map), np.frombuffer(blob[:64], np.int32).tolist()
        at, parts = 64, []
        for size, n in zip(head[::2], head[1::2]):
            parts.append((at, view[at : at + size * n].cast("B" if size == 1 else "i")))
            at += size * n + (-size * n) % 4
        self._labels_at = parts[1][0]
        (self._root,), self._final, self._first, self._target, self._add, self._start, self.ids = (
            p[1] for p in (parts[0], *parts[2:])
        )

        # Where the first bytes of a key lead; most unknown keys end here.
        self._heads = dict(self._walk(HEAD))

    def _walk(self, depth: int) -> Iterator[tuple[bytes, tuple[int, int]]]:
        """(bytes, (state, sum)) of all paths of ``depth`` arcs; at most one per entry."""
        stack = [(b"", self._root, 0)]
        while stack:
            path, state, total = stack.pop()
            if len(path) == depth:
                yield path, (state, total)
                continue
            for arc in range(self._first[state], self._first[state + 1]):
                label = self._map[self._labels_at + arc : self._labels_at + arc + 1]
                stack.append((path + label, self._target[arc], total + self._add[arc]))

    def rank(self, key: bytes) -> int:
        """Place of the key among the sorted keys, or -1."""
        at = HEAD if len(key) >= HEAD else 0
        state, total = self._heads.get(key[:HEAD], (-1, 0)) if at else (self._root, 0)
        if state < 0:
            return -1
        base, find, first = self._labels_at, self._map.find, self._first
        for i in range(at, len(key)):
            arc = find(key[i : i + 1], base + first[state], base + first[state + 1]) - base
            if arc < 0:
                return -1
            total += self._add[arc]
            state = self._target[arc]
        return total if self._final[state] else -1

    def lookup(self, key: bytes) -> memoryview | None:
        n = self.rank(key)
        return None if n < 0 else self.ids[self._start[n] : self._start[n + 1]]


@dataclass
class Encoder:
    """What a worker needs to encode: the vocabulary, the lexicon, recent chunks."""

    vocabulary: Vocabulary
    lexicon: Lexicon
    memory: int = 300_000
    _recent: dict[str, bytes] = field(default_factory=dict)
    _words: dict[str, bytes] = field(default_factory=dict)

    def learn(self, chunks: set[str]) -> None:
        """Remember the ids of chunks: from the lexicon, or of their words."""
        if len(self._recent) + len(chunks) > self.memory:
            self._recent.clear()
        if len(self._words) > self.memory // 2:
            self._words.clear()
        lookup, recent, words = self.lexicon.lookup, self._recent, self._words
        unknown: dict[str, list[str]] = {}
        for chunk in chunks:
            known = lookup(chunk.encode())
            if known is not None:
                recent[chunk] = known.tobytes()
            else:
                body = chunk[1:] if chunk[0] == " " else chunk
                unknown[chunk] = [chunk] if body.isalpha() else _WORD.findall(chunk)
        new = list({w for parts in unknown.values() for w in parts if w not in words})
        raw = [w.encode() for w in new]
        short = [i for i, w in enumerate(raw) if len(w) <= LONG]
        words.update(zip([new[i] for i in short], self.vocabulary.merge_all([raw[i] for i in short])))
        for w, data in zip(new, raw):
            if len(data) > LONG:
                words[w] = array("i", self.vocabulary.merge(data)).tobytes()
        for chunk, parts in unknown.items():
            recent[chunk] = words[parts[0]] if len(parts) == 1 else b"".join([words[w] for w in parts])

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of every text as packed 32-bit integers."""
        added = {t: np.int32(i).tobytes() for t, i in self.vocabulary.added.items()}
        rows = []
        for text in texts:
            pieces = split_added(text, added)
            rows.append([c for p in pieces for c in ([p] if p in added else _CHUNK.findall(p))])
        recent = self._recent
        missing = {c for row in rows for c in row if c not in recent}.difference(added)
        if missing:
            held = {c: recent[c] for row in rows for c in row if c in recent} if len(recent) + len(missing) > self.memory else {}
            self.learn(missing)
            recent.update(held)
        return [b"".join([added[c] if c in added else recent[c] for c in row]) for row in rows]


def split_added(text: str, added: dict[str, int]) -> list[str]:
    """The text cut at added tokens, which stay as pieces of their own."""
    if not any(t in text for t in added):
        return [text]
    pattern = "|".join(re.escape(t) for t in sorted(added, key=len, reverse=True))
    return [p for p in re.split(f"({pattern})", text) if p]


def frequent_chunks(docs: DataFrame, added: dict[str, int], limit: int, text: str = "text") -> list[str]:
    """The ``limit`` most frequent chunks of all documents; ties by their text.

    Chunks are counted in each task (in rounds of bounded size) and summed in Spark.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def flush() -> pa.RecordBatch:
            made = pa.RecordBatch.from_pydict({"chunk": list(seen), "n": pa.array(seen.values(), pa.int64())})
            seen.clear()
            return made

        for batch in slices(batches):
            for value in batch.column(0).to_pylist():
                for piece in split_added(value or "", added):
                    if piece not in added:
                        seen.update(_CHUNK.findall(piece))
                if len(seen) > 500_000:
                    yield flush()
        if seen:
            yield flush()

    summed = docs.select(text).mapInArrow(count, "chunk string, n long").groupBy("chunk").agg(F.sum("n").alias("n"))
    return [r["chunk"] for r in most_frequent(summed, "chunk", limit)]


def slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of at most ``rows`` rows."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


_LOADED: dict[str, Encoder] = {}


def encode(
    docs: DataFrame, vocabulary_path: str, lexicon_chunks: int = 32_768, text: str = "text", ids: str = "ids"
) -> DataFrame:
    """``docs`` with the token ids of every text, as an array column."""
    vocabulary = Vocabulary.read(vocabulary_path)
    chunks = frequent_chunks(docs, vocabulary.added, lexicon_chunks, text)
    blob = compile_lexicon({c.encode(): vocabulary.encode(c) for c in chunks})
    shared = docs.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, vocabulary, blob))
    kept = docs.drop(ids)
    at = kept.columns.index(text)
    out = StructType([*kept.schema.fields, StructField(ids, ArrayType(IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, words, arrays = shared.value
        if name not in _LOADED:
            _LOADED.clear()
            _LOADED[name] = Encoder(words, Lexicon(arrays))
        encoder = _LOADED[name]
        for batch in slices(batches):
            packed = encoder.encode([value or "" for value in batch.column(at).to_pylist()])
            ends = np.cumsum([0, *(len(p) // 4 for p in packed)], dtype=np.int32)
            values = pa.array(np.frombuffer(b"".join(packed), np.int32))
            column = pa.ListArray.from_arrays(pa.array(ends), values)
            yield pa.RecordBatch.from_arrays([*batch.columns, column], names=out.names)

    return kept.mapInArrow(run, out)


def decode(encoded: DataFrame, vocabulary_path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """``encoded`` with the text of every id array; ids of added tokens are not skipped.

    Bytes that are no UTF-8 become the replacement character.
    """
    shared = encoded.sparkSession.sparkContext.broadcast(Vocabulary.read(vocabulary_path).pieces)
    kept = encoded.drop(text)
    at = kept.columns.index(ids)
    out = StructType([*kept.schema.fields, StructField(text, StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = shared.value
        for batch in slices(batches):
            made = []
            for row in batch.column(at):
                wanted = row.values.to_numpy().tolist() if row.is_valid else []
                made.append(b"".join([pieces[i] for i in wanted]).decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.string())], names=out.names)

    return kept.mapInArrow(run, out)


def digest(decoded: DataFrame, key: str = "doc_id", ids: str = "ids", text: str = "decoded") -> DataFrame:
    """Counts and digests of ids and decoded texts."""
    return decoded.select(
        key,
        F.size(ids).cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col(ids).cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2(text, 256).alias("decoded_sha256"),
    )
