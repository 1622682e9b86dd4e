"""Toxicity by a weighted finite-state grammar over clauses.

Five small transducers read a text as a sequence of symbols: an insult, a threat, a
target (you, they, ...), a negation, a reporting verb, a clause end, or any other word.
Each keeps what it has seen: a negation is open for a few words, a reporting verb until
the clause ends, a target stays near for a few words, and so on. They are composed into
one automaton, read from left to right; a target that comes after the word is found by
the same transducer read from right to left. So an insult or threat is emitted as one of
the match kinds "targeted or not, negated or not, reported or not", and the matches of a
kind in one clause are one matched clause. Clauses are what is scored: a document's
features are the weights of its matched clauses by kind, and the largest, number and rate
of them by stance (addressed, open, negated, reported). No feature adds up across
stances; the weights of all are learned.

Learning uses at most ``max_rows`` labelled training rows (the labels with the smallest
hash of their id, a documented bound on the model's training set): the terms are the words
and word stems whose presence tells toxic rows from others (log-odds), at most
``max_terms`` of them. A term that stands before its target in more toxic rows than after
it ("... you") is a threat, any other an insult; the threats listed here count as such
from the start, with weight 1 where nothing was learned. The weights of the features come
from a logistic regression. What is scored is every row, and a score sees the text alone.

Nulls: a null text is empty; an empty text has the score of a text without matches. Rows
whose label is null or missing, or whose id is null, are not learned from. A repeated
label counts once, the toxic one first. Without both kinds of label nothing can be told
apart, and every row gets the (smoothed) base rate. Extra columns stay; columns named
like the output are replaced.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator, Mapping
from dataclasses import dataclass, field
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

# Closed word classes of four languages.
TARGETS = "you your you're he she they them him her us these those du ihr euch dich sie er tu vous toi ils elles tú usted ustedes vosotros ellos".split()
NEGATIONS = "not no never isn't aren't don't nicht kein keine keinen nie ne pas jamais nunca jamás".split()
REPORTS = "said says say wrote writes quoted quote claimed claims reported sagte sagt schrieb behauptet dit disait écrit affirme dijo dice escribió afirma".split()
THREATS = "kill murder hurt destroy shoot stab töten umbringen schlagen tuer frapper détruire matar golpear destruir".split()

INSULT, THREAT, TARGET, NEGATION, REPORT, STOP, OTHER = range(7)
_TOKEN = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?|[.,;:!?|]")
_STEMS = range(3, 10)


@dataclass(frozen=True)
class Machine:
    """A transducer over symbols: table[state][symbol] -> (next state, mark)."""

    table: tuple[tuple[tuple[int, int], ...], ...]


def memory(opens: int, span: int | None, marks: tuple[int, ...] = (INSULT, THREAT)) -> Machine:
    """Marks a symbol of ``marks`` that comes while the symbol ``opens`` is remembered.

    It is remembered for ``span`` further symbols, or up to the clause end.
    """
    size = 2 if span is None else span + 1
    rows = []
    for state in range(size):
        row = []
        for symbol in range(7):
            after = size - 1 if symbol == opens else 0 if symbol == STOP else state if span is None else max(state - 1, 0)
            row.append((after, int(state > 0 and symbol in marks)))
        rows.append(tuple(row))
    return Machine(tuple(rows))


def emitter(symbol: int) -> Machine:
    """Marks one symbol wherever it stands."""
    return Machine((tuple((0, int(s == symbol)) for s in range(7)),))


def compose(machines: list[Machine]) -> Machine:
    """All machines at once: only states that can be reached, the marks as one number."""
    start = (0,) * len(machines)
    number, order, table = {start: 0}, [start], []
    for states in order:
        row = []
        for symbol in range(7):
            moves = [m.table[s][symbol] for m, s in zip(machines, states)]
            after = tuple(a for a, _ in moves)
            if after not in number:
                number[after] = len(order)
                order.append(after)
            row.append((number[after], sum(mark << k for k, (_, mark) in enumerate(moves))))
        table.append(tuple(row))
    return Machine(tuple(table))


# Bits of a match kind: insult, threat, targeted, negated, reported.
NEAR = 4
GRAMMAR = compose([emitter(INSULT), emitter(THREAT), memory(TARGET, NEAR), memory(NEGATION, 3), memory(REPORT, None)])
AHEAD = memory(TARGET, NEAR)  # read from right to left
KINDS = [i + (t << 2) + (n << 3) + (r << 4) for i, t, n, r in product((1, 2), (0, 1), (0, 1), (0, 1))]
ADDRESSED, OPEN, NEGATED, REPORTED = range(4)
FEATURES = len(KINDS) + 3 * 4


def stance(kind: int) -> int:
    """Who stands behind a match: reported and negated matches are groups of their own."""
    return REPORTED if kind & 16 else NEGATED if kind & 8 else ADDRESSED if kind & 4 else OPEN


def terms_of(word: str) -> list[str]:
    """The word and its stems; a stem ends in ``*``."""
    return [word, *(word[:n] + "*" for n in _STEMS if n < len(word))]


def beside_target(tokens: list[str]) -> set[str]:
    """The words that come within two symbols after a target, in its clause."""
    state, found = 0, set()
    for token in tokens:
        symbol = TARGET if token in TARGETS else OTHER if token[0].isalpha() else STOP
        state, mark = _BESIDE.table[state][symbol]
        if mark:
            found.add(token)
    return found


_BESIDE = memory(TARGET, 2, marks=(OTHER,))


@dataclass
class Grammar:
    """The composed automaton with learned insults and threats: texts to features."""

    insults: Mapping[str, float]
    threats: Mapping[str, float] = field(default_factory=dict)
    memory: int = 200_000
    _recent: dict[str, tuple] = field(default_factory=dict)

    def _symbols(self, chunk: str) -> tuple[tuple[int, float], ...]:
        fixed = {THREAT: THREATS, TARGET: TARGETS, NEGATION: NEGATIONS, REPORT: REPORTS}
        out = []
        for token in _TOKEN.findall(chunk.lower()):
            terms = terms_of(token)
            insult = max((self.insults.get(t, 0.0) for t in terms), default=0.0)
            threat = max((self.threats.get(t, 0.0) for t in terms), default=0.0)
            if threat > insult or token in THREATS and insult > 0:
                out.append((THREAT, max(threat, insult)))
            elif insult > 0:
                out.append((INSULT, insult))
            elif not token[0].isalpha():
                out.append((STOP, 0.0))
            else:
                out.append((next((k for k, words in fixed.items() if token in words), OTHER), 1.0))
        if len(self._recent) >= self.memory:
            self._recent.clear()
        self._recent[chunk] = made = tuple(out)
        return made

    def matches(self, text: str) -> list[tuple[int, float]]:
        """(kind, weight) of every matched clause, in order; a clause counts once a kind."""
        recent, symbols = self._recent, self._symbols
        row = []
        for line in text.split("\n"):
            row += [recent[c] if c in recent else symbols(c) for c in line.split()]
            row.append(((STOP, 0.0),))
        flat = [s for part in row for s in part]
        if not any(s[0] <= THREAT for s in flat):
            return []
        table, state, found, clause = GRAMMAR.table, 0, [], {}
        for at, (symbol, weight) in enumerate(flat):
            state, mark = table[state][symbol]
            if mark:
                mark |= self._ahead(flat[at : at + NEAR + 1]) << 2
                clause[mark] = clause.get(mark, 0.0) + weight
            elif symbol == STOP and clause:
                found += clause.items()
                clause = {}
        return found

    @staticmethod
    def _ahead(symbols: list[tuple[int, float]]) -> int:
        """Whether a target follows the first symbol, near and in its clause."""
        state = mark = 0
        for symbol, _ in reversed(symbols):
            state, mark = AHEAD.table[state][symbol]
        return mark

    def features(self, text: str) -> list[float]:
        by_kind, stances = dict.fromkeys(KINDS, 0.0), [[] for _ in range(4)]
        for kind, weight in self.matches(text):
            by_kind[kind] += weight
            stances[stance(kind)].append(weight)
        # Clauses per word: one chance match of a stem means less in a long text.
        part = 100 / (len(text) / 6 + 20)
        row = [*map(math.log1p, by_kind.values())]
        for weights in stances:
            row += [max(weights, default=0.0), math.log1p(len(weights)), math.log1p(sum(weights) * part)]
        return row


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 50) -> np.ndarray:
    """Weights with the intercept first, by Newton's method."""
    x = np.hstack([np.ones((len(x), 1)), x])
    penalty = np.full(x.shape[1], ridge)
    penalty[0] = 1e-3
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x.T * (p * (1 - p))) @ x + np.diag(penalty), x.T @ (p - y) + penalty * w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


@dataclass(frozen=True)
class Model:
    insults: dict[str, float]
    threats: dict[str, float]
    weights: tuple[float, ...]


def held_out(key: str = "doc_id", parts: int = 4, out: int = 2) -> F.Column:
    """Rows kept from training: CRC-32 of the id as text, modulo ``parts``, is ``out``."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % parts == out, F.lit(False))


def learn(
    docs: DataFrame,
    labels: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    label: str = "toxic",
    max_rows: int = 20_000,
    max_terms: int = 5_000,
    min_rows: int = 4,
    min_odds: float = 2.5,
) -> Model:
    """Insults, threats and weights from the training rows."""
    known = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull() & ~held_out(key))
    known = known.groupBy(F.col(key).alias("_key")).agg(F.max(label).cast("int").alias("_toxic"))
    sample = known.orderBy(F.xxhash64("_key"), "_key").limit(max_rows)
    # Broadcast: bounded by max_rows.
    rows = docs.select(F.col(key).alias("_key"), F.coalesce(F.col(text), F.lit("")).alias("text")).join(
        F.broadcast(sample), "_key"
    ).select("text", "_toxic")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Rows with the term, by label; toxic rows where it stands before, after a target.
        seen = [Counter() for _ in range(4)]
        for batch in batches:
            for value, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                tokens = _TOKEN.findall(value.lower())
                groups = [(toxic, {w for w in tokens if w[0].isalpha()})]
                if toxic:
                    groups += [(2, beside_target(tokens[::-1])), (3, beside_target(tokens))]
                for k, words in groups:
                    seen[k].update({t for w in words for t in terms_of(w)})
                seen[toxic][""] += 1
        terms = [*(seen[0] | seen[1])]
        columns = [pa.array(terms, pa.string()), *(pa.array([s[t] for t in terms], pa.int64()) for s in seen)]
        yield pa.RecordBatch.from_arrays(columns, names=names)

    names = ["term", "clean", "toxic", "before", "after"]
    counted = rows.mapInArrow(count, "term string, clean long, toxic long, before long, after long")
    counted = counted.groupBy("term").agg(*(F.sum(n).alias(n) for n in names[1:]))
    total = counted.where("term = ''").first()
    clean, toxic = (total["clean"], total["toxic"]) if total else (0, 0)
    base = math.log((toxic + 0.5) / (clean + 0.5))
    flat = Model({}, {}, (base, *[0.0] * FEATURES))
    if not clean or not toxic:
        return flat
    odds = F.log((F.col("toxic") + 0.5) / (toxic + 1)) - F.log((F.col("clean") + 0.5) / (clean + 1))
    best = (
        counted.where((F.col("term") != "") & (F.col("toxic") >= min_rows))
        .withColumn("odds", odds)
        .where(F.col("odds") >= min_odds)
        .orderBy(F.desc(F.col("odds") * F.sqrt("toxic")), "term")
        .limit(max_terms)
        .collect()
    )
    if not best:
        return flat
    threats = {r["term"]: r["odds"] for r in best if r["before"] > r["after"]}
    insults = {r["term"]: r["odds"] for r in best if r["before"] <= r["after"]}
    shared = docs.sparkSession.sparkContext.broadcast((insults, threats))

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grammar = Grammar(*shared.value)
        for batch in batches:
            x = [grammar.features(v) for v in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), batch.column(1)], names=["x", "y"])

    fitted = rows.mapInArrow(featured, "x array<double>, y int").collect()  # max_rows at most
    fitted.sort()
    w = fit_logistic(np.array([r["x"] for r in fitted]), np.array([r["y"] for r in fitted], float))
    return Model(insults, threats, tuple(w.tolist()))


def score(docs: DataFrame, model: Model, text: str = "text", out: str = "score") -> DataFrame:
    """``docs`` with the probability that a row is toxic."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by max_terms
    kept = docs.drop(out)
    at = kept.columns.index(text)
    schema = StructType([*kept.schema.fields, StructField(out, DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        grammar, (base, *weights) = Grammar(model.insults, model.threats), model.weights
        for batch in batches:
            z = [base + sum(map(float.__mul__, weights, grammar.features(v or ""))) for v in batch.column(at).to_pylist()]
            p = 1 / (1 + np.exp(-np.clip(np.array(z, float), -30, 30)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p)], names=schema.names)

    return kept.mapInArrow(run, schema)
