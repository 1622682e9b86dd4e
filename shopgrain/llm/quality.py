"""Quality rules, with divergence from language references as their verdict.

Every text gets the base figures (words, symbols, repeated lines and word windows) and two
histograms: its characters by class, and its counts of the words that are common in the
languages of the corpus. A reference is the sum of the histograms of a language. A text
is compared with the references by the Jensen-Shannon distance (the square root of the
divergence, in bits) of both histograms; the nearest language counts, so a wrong language
tag does no harm.

References come from the corpus: common words from all texts, sums from the texts that
pass the base rules. As junk would pull the references towards itself, they are summed
again over the texts that lie near the first ones (``trim``).

Short texts scatter: a distance may be larger by a share of one over the square root of
the length (``char_limit + char_slack / sqrt(characters)``, and so for words), and the
word test needs ``min_words`` words.

Nulls: a null text has no words and fails the base rules. A null language is a language
of its own. Copies are judged row by row. Without any reference (an empty table, or no
text that passes the base rules) the base rules alone decide. Extra columns are not
carried.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shopgrain.llm.frequent import most_frequent
from shopgrain.session import stored

# Bytes by class. Every character counts once, by its first byte.
_CLASSES = [
    b"abcdefghijklmnopqrstuvwxyz",
    b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    b"0123456789",
    b" \t",
    b"\n\r\x0b\x0c",
    b".,",
    b";:!?'\"()-",
    b"#*$%&",
    b"|<>@_=+/\\{}[]~^`",
    bytes(range(0xC0, 0x100)),
    bytes(b for b in range(128) if b < 9 or 13 < b < 32 or b == 127),
]
CLASS_OF = np.zeros((256, len(_CLASSES)), np.int64)
for _n, _members in enumerate(_CLASSES):
    CLASS_OF[list(_members), _n] = 1
_SPACE, _SYMBOLS = list(b" \t\n\r\x0b\x0c"), list(b"#*$%&|<>")
_EDGES = ".,;:!?'\"()-"

FIGURES = (
    "doc_id long, lang string, n_words long, word_chars long, n_symbols long, n_dup_lines long, "
    "n_repeat_words long, chars array<long>, common array<int>"
)


@dataclass(frozen=True)
class Limits:
    """Thresholds of the rules."""

    min_words: int = 50
    max_repeat_percent: int = 50
    char_limit: float = 0.14
    char_slack: float = 2.0
    word_limit: float = 0.18
    word_slack: float = 1.8
    trim: tuple[float, float] = (0.16, 0.40)


def plain(chunk: str) -> str:
    """A word without the punctuation around it, in lower case."""
    return chunk.strip(_EDGES).lower()


def common_words(docs: DataFrame, per_language: int = 50, lang: str = "lang", text: str = "text") -> dict[str, list[str]]:
    """The most frequent words of every language, counted over all texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, Counter] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for language, chunks in seen.items():
                words: Counter = Counter()
                for chunk, n in chunks.items():
                    if word := plain(chunk.decode()):
                        words[word] += n
                yield pa.RecordBatch.from_pydict(
                    {
                        "language": pa.array([language] * len(words), pa.string()),
                        "word": pa.array(list(words), pa.string()),
                        "n": pa.array(words.values(), pa.int64()),
                    }
                )
            seen.clear()

        for batch in batches:
            for language, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                seen.setdefault(language, Counter()).update((value or b"").split())
            if sum(map(len, seen.values())) > 400_000:
                yield from flush()
        yield from flush()

    rows = docs.select(F.coalesce(F.col(lang), F.lit("")), F.col(text).cast("binary"))
    counted = rows.mapInArrow(count, "language string, word string, n long")
    summed = counted.groupBy("language", "word").agg(F.sum("n").alias("n"))
    found: dict[str, list[str]] = {}
    for r in sorted(most_frequent(summed, "word", per_language, "language"), key=lambda r: (r["language"], -r["n"], r["word"])):
        found.setdefault(r["language"], []).append(r["word"])
    return found


def base_figures(text: bytes, words: list[bytes], bytes_seen: np.ndarray) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of one text."""
    points = len(text) - int(bytes_seen[0x80:0xC0].sum())
    lines = [line for line in text.split(b"\n") if line.split(None, 1)]
    windows = list(zip(words, words[1:], words[2:]))
    repeated = 0
    if len(set(windows)) < len(windows):
        times, end = Counter(windows), 0
        for i, w in enumerate(windows):
            if times[w] > 1:
                repeated += i + 3 - max(end, i)
                end = i + 3
    return (
        len(words),
        points - int(bytes_seen[_SPACE].sum()),
        int(bytes_seen[_SYMBOLS].sum()),
        len(lines) - len(set(lines)),
        repeated,
    )


def figures(
    docs: DataFrame, vocabulary: list[str], key: str = "doc_id", lang: str = "lang", text: str = "text"
) -> DataFrame:
    """Base figures and both histograms of every row."""
    shared = docs.sparkSession.sparkContext.broadcast({w: i for i, w in enumerate(vocabulary)})
    size = len(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, recent = shared.value, {}
        for batch in batches:
            base, chars, common = [], [], []
            for value in batch.column(2).to_pylist():
                value = value or b""
                words = value.split()
                seen = np.bincount(np.frombuffer(value, np.uint8), minlength=256)
                base.append(base_figures(value, words, seen))
                chars.append(seen @ CLASS_OF)
                if len(recent) > 400_000:
                    recent.clear()
                at = []
                for w in words:
                    i = recent.get(w)
                    if i is None:
                        i = recent[w] = place.get(plain(w.decode()), size)
                    at.append(i)
                common.append(np.bincount(np.array(at, np.int64), minlength=size + 1)[:size])
            n = len(base)
            columns = [pa.array(c, pa.int64()) for c in (zip(*base) if n else [[]] * 5)]
            for made, width, kind in ((chars, len(_CLASSES), np.int64), (common, size, np.int32)):
                flat = np.concatenate(made).astype(kind) if n else np.empty(0, kind)
                columns.append(pa.ListArray.from_arrays(np.arange(0, (n + 1) * width, width or 1, np.int32)[: n + 1] if width else np.zeros(n + 1, np.int32), pa.array(flat)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *columns], names=[f.split()[0] for f in FIGURES.split(", ")])

    rows = docs.select(
        F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(lang), F.lit("")).alias("lang"), F.col(text).cast("binary")
    )
    return rows.mapInArrow(run, FIGURES)


def distance(rows: np.ndarray, reference: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance of every row of counts from the reference, 0 to 1."""
    p = rows / np.maximum(rows.sum(1, keepdims=True), 1)
    q = np.broadcast_to(reference / max(reference.sum(), 1), p.shape)
    m = (p + q) / 2

    def part(a: np.ndarray) -> np.ndarray:
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(a > 0, a * np.log2(a / m), 0).sum(1)

    return np.sqrt(np.clip((part(p) + part(q)) / 2, 0, 1))


@dataclass(frozen=True)
class References:
    """Per language: sums of the character classes and of all common words, words in all."""

    own: dict[str, list[int]]  # places of a language's own common words
    chars: dict[str, np.ndarray]
    words: dict[str, np.ndarray]
    n_words: dict[str, int]

    def nearest(self, chars: np.ndarray, common: np.ndarray, n_words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distances (characters, words) from the language that is nearest in sum."""
        best = np.full((2, len(chars)), np.inf)
        for language in self.chars:
            own = self.own[language]
            mine, theirs = common[:, own], self.words[language][own]
            rest = np.maximum(n_words - mine.sum(1), 0)
            d = np.stack(
                [
                    distance(chars, self.chars[language]),
                    distance(
                        np.column_stack([mine, rest]), np.append(theirs, max(self.n_words[language] - theirs.sum(), 0))
                    ),
                ]
            )
            best = np.where(d.sum(0) < best.sum(0), d, best)
        return best[0], best[1]


def base_failed(limits: Limits) -> F.Column:
    return (F.col("n_words") < limits.min_words) | (
        100 * F.col("n_repeat_words") > limits.max_repeat_percent * F.col("n_words")
    )


def _matrices(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = batch.num_rows
    chars, common = (batch.column(c).flatten().to_numpy().reshape(n, -1) if n else np.empty((0, 0)) for c in ("chars", "common"))
    return chars, common, batch.column("n_words").to_numpy()


def references(rows: DataFrame, own: dict[str, list[int]], limits: Limits, before: References | None = None) -> References:
    """Sums by language over the rows of ``figures`` that pass the base rules.

    With ``before``, only rows within ``limits.trim`` of it are summed. Each task sends
    one row per language, and these are added up in Spark.
    """

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            chars, common, n_words = _matrices(batch)
            keep = np.ones(batch.num_rows, bool)
            if before is not None and batch.num_rows:
                by_char, by_word = before.nearest(chars, common, n_words)
                keep = (by_char <= limits.trim[0]) & (by_word <= limits.trim[1])
            language = np.array(batch.column("lang").to_pylist(), object)
            for name in set(language[keep]):
                own_rows = keep & (language == name)
                line = np.concatenate([chars[own_rows].sum(0), common[own_rows].sum(0), [n_words[own_rows].sum()]])
                sums[name] = sums.get(name, 0) + line
        for name, line in sums.items():
            yield pa.RecordBatch.from_pydict(
                {
                    "lang": pa.array([name] * len(line), pa.string()),
                    "at": pa.array(np.arange(len(line)), pa.int32()),
                    "n": pa.array(line.astype(np.int64)),
                }
            )

    used = rows.where(~base_failed(limits)).select("lang", "n_words", "chars", "common")
    summed = used.mapInArrow(add, "lang string, at int, n long").groupBy("lang", "at").agg(F.sum("n").alias("n"))
    lines: dict[str, dict[int, int]] = {}
    for r in summed.collect():  # languages times histogram places
        lines.setdefault(r["lang"], {})[r["at"]] = r["n"]
    k = len(_CLASSES)
    made = {name: np.array([line[i] for i in sorted(line)], float) for name, line in sorted(lines.items()) if name in own}
    if before is not None:  # a language whose texts all lie apart keeps its first sums
        made = {n: np.concatenate([c, before.words[n], [before.n_words[n]]]) for n, c in before.chars.items()} | made
    return References(
        own, {n: v[:k] for n, v in made.items()}, {n: v[k:-1] for n, v in made.items()}, {n: int(v[-1]) for n, v in made.items()}
    )


def judge(
    docs: DataFrame,
    key: str = "doc_id",
    lang: str = "lang",
    text: str = "text",
    limits: Limits = Limits(),
    per_language: int = 50,
) -> DataFrame:
    """Base figures, both distances (null without a reference) and the verdict of every row."""
    words = common_words(docs, per_language, lang, text)
    vocabulary = sorted({w for own in words.values() for w in own})
    place = {w: i for i, w in enumerate(vocabulary)}
    own = {language: [place[w] for w in ws] for language, ws in words.items()}
    rows = stored(figures(docs, vocabulary, key, lang, text), "quality")
    found = references(rows, own, limits, references(rows, own, limits))
    shared = docs.sparkSession.sparkContext.broadcast(found)  # languages times histogram places
    base = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            chars, common, n_words = _matrices(batch)
            by_char, by_word = shared.value.nearest(chars, common, n_words)
            none = ~np.isfinite(by_char)
            columns = [batch.column(c) for c in base]
            columns += [pa.array(d, pa.float64(), mask=none) for d in (by_char, by_word)]
            columns.append(pa.array(chars.sum(1) if batch.num_rows else [], pa.int64()))
            yield pa.RecordBatch.from_arrays(columns, names=[*base, "char_distance", "word_distance", "n_chars"])

    ddl = ", ".join(f"{c} long" for c in base) + ", char_distance double, word_distance double, n_chars long"
    far = (
        F.col("char_distance") > limits.char_limit + limits.char_slack / F.sqrt(F.greatest("n_chars", F.lit(1)))
    ) | (
        (F.col("n_words") >= limits.min_words)
        & (F.col("word_distance") > limits.word_limit + limits.word_slack / F.sqrt(F.greatest("n_words", F.lit(1))))
    )
    return (
        rows.mapInArrow(compare, ddl)
        .withColumn("base_failed", base_failed(limits))
        .withColumn("kept", ~F.col("base_failed") & ~F.coalesce(far, F.lit(False)))
        .withColumnRenamed("doc_id", key)
    )
