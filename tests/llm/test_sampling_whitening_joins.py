"""Importance resampling, embedding whitening and the n-gram Jaccard join against brute force."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from shopgrain.llm import importance, jaccard, whitening
from tests.llm.test_operators import AWKWARD, prose, words

CLASHES = ["key", "mark", "row", "rank", "score", "weight", "down", "node", "part", "body", "n", "component_id", "x"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, *["clash"] * len(CLASHES)) for i, t in AWKWARD]
    return spark.createDataFrame(rows, ", ".join(["doc_id long", "text string", *(f"{c} string" for c in CLASHES)])).repartition(3)


# --- importance resampling -----------------------------------------------------------


def plain_words(text: str | None) -> list[str]:
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute_resample(rows, target, percent, min_words, buckets, longest):
    def features(text):
        w = plain_words(text)
        runs = [" ".join(w[i : i + k]) for k in range(1, longest + 1) for i in range(len(w) - k + 1)]
        return len(w), [zlib.crc32(r.encode()) % buckets for r in runs]

    s = Counter(b for _, t in rows for b in features(t)[1])
    t = Counter(b for text in target for b in features(text)[1])
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = {
        b: math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets)))) for b in s
    }
    found = []
    for key, text in rows:
        n, own = features(text)
        weight = sum(gain[b] for b in own) // len(own) if own else 0
        h = int(hashlib.sha256(f"2024:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
        found.append((key, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), n))
    able = sorted((f for f in found if f[4] >= min_words), key=lambda f: (-f[3], f[0] is None, f[0] or 0))
    return [f[:4] for f in found], [f[0] for f in able[: percent * len(able) // 100]]


@pytest.mark.parametrize("percent, min_words, longest, pivots", [(10, 20, 1, 3), (50, 0, 2, 32), (100, 1, 1, 2), (0, 1, 1, 2)])
def test_resample_equals_brute_force(spark, percent, min_words, longest, pivots):
    rng = random.Random(4)
    rows = [*AWKWARD, *((100 + k, prose(k % 90, rng.randrange(1, 60))) for k in range(300))]
    rows += [(k % 3, prose(900, 30)) for k in range(60)]  # ties: equal texts with equal keys
    target = [prose(k, 25) for k in range(5)] + [None, ""]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    aim = spark.createDataFrame([(t,) for t in target], "text string")
    got = importance.resample(df, aim, percent, min_words, 500, longest, pivots=pivots).collect()
    figures, drawn = brute_resample(rows, target, percent, min_words, 500, longest)
    assert Counter((r["doc_id"], r["n_features"], r["weight"], r["score"]) for r in got) == Counter(figures)
    ranks = sorted((r["rank"], r["doc_id"]) for r in got if r["rank"] is not None)
    assert [r for r, _ in ranks] == list(range(1, len(drawn) + 1))
    assert [k for _, k in ranks] == drawn


def test_resample_of_awkward_and_empty_tables(docs):
    aim = docs.limit(0)
    got = importance.resample(docs, aim, percent=50, min_words=1)
    assert got.columns == ["doc_id", *importance.OUT] and got.count() == len(AWKWARD)
    assert {r["weight"] for r in got.where("doc_id in (3, 4, 5)").collect()} == {0}
    assert importance.resample(aim, docs).count() == 0


def test_kth_of_ties(spark):
    df = spark.range(0, 500).selectExpr("id div 100 as a", "if(id % 7 = 0, null, id % 5) as b", "id as c").cache()
    order = sorted(((r["a"], r["b"] is not None, r["b"] or 0, r["c"]) for r in df.collect()))
    for k in (1, 2, 77, 250, 499, 500):
        r = importance.kth(df, ("a", "b", "c"), k, pivots=4)
        assert (r["a"], r["b"] is not None, r["b"] or 0, r["c"]) == order[k - 1]


# --- embedding whitening -------------------------------------------------------------


def brute_whiten(rows, components, scale=256):
    kept = [(i, v) for i, v in rows if v and all(e is not None and math.isfinite(e) for e in v)]
    size = Counter(len(v) for _, v in kept).most_common(1)[0][0]
    kept = [(i, [math.floor(scale * float(e)) for e in v]) for i, v in kept if len(v) == size]
    fit = sorted({tuple(x) for _, x in kept})
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    d = np.array(fit, float) - np.array([s / n for s in sums])
    cov = d.T @ d / n
    e, v = np.linalg.eigh(cov)
    e, v = e[::-1], v[:, ::-1]
    deviation = {tuple(x): sum((n * a - s) ** 2 for a, s in zip(x, sums)) for _, x in kept}
    white = {tuple(x): (np.array(x) - np.array(sums) / n) @ v[:, :components] / np.sqrt(e[:components]) for _, x in kept}
    return kept, n, deviation, white, e / np.trace(cov)


def test_whitening_equals_brute_force(spark):
    rng = np.random.default_rng(7)
    base = rng.normal(size=(120, 9)) * np.arange(1, 10) @ rng.normal(size=(9, 9))
    rows = [(k, [float(np.float32(x)) for x in v]) for k, v in enumerate(base)]
    rows += [(1000 + k, rows[0][1]) for k in range(200)]  # copies do not turn the axes
    rows += [(1, rows[5][1]), (None, rows[6][1]), (2000, None), (2001, []), (2002, [1.0] * 8), (2003, [1.0] * 8 + [None])]
    rows += [(2004, [float("nan")] + [0.0] * 8), (2005, [float("inf")] + [0.0] * 8)]
    df = spark.createDataFrame([(i, v, "clash", "clash") for i, v in rows], "vec_id long, embedding array<float>, x string, size string")
    got = whitening.whiten(df.repartition(5), components=4).collect()
    kept, n, deviation, white, explained = brute_whiten(rows, 4)
    assert Counter((r["vec_id"], r["component"]) for r in got) == Counter((i, c) for i, _ in kept for c in range(1, 5))
    assert len({r["n"] for r in got}) == 1 and got[0]["n"] == n == 120
    sign, by_id = {}, {i: tuple(x) for i, x in kept}
    for r in got:
        if r["vec_id"] in (None, 1):
            continue
        x, c = by_id[r["vec_id"]], r["component"] - 1
        assert int(r["deviation"]) == deviation[x]
        want = white[x][c]
        s = sign.setdefault(c, 1.0 if abs(r["whitened"] - want) < abs(r["whitened"] + want) else -1.0)
        assert r["whitened"] * s == pytest.approx(want, abs=1e-8)
        assert r["explained"] == pytest.approx(explained[c], rel=1e-10)
        assert r["identity_error"] < 1e-9


@pytest.mark.parametrize("rank", [1, 3, 8])
def test_factor_and_rotations(rank):
    rng = np.random.default_rng(rank)
    a = rng.normal(size=(8, rank)) * 10.0 ** -np.arange(rank)
    c = a @ a.T
    factor = whitening.pivoted_cholesky(c)
    assert factor.shape == (8, rank) and np.allclose(factor @ factor.T, c, atol=1e-12)
    order = np.argsort([-np.abs(factor[i]).max() for i in range(8)])
    assert order.shape == (8,)
    turned = whitening.one_sided_jacobi(factor)
    gram = turned.T @ turned
    assert np.abs(gram - np.diag(np.diag(gram))).max() < 1e-12 * gram.max()
    assert np.allclose(np.diag(gram), np.sort(np.linalg.eigvalsh(c))[::-1][:rank], rtol=1e-6)


def test_whitening_of_few_and_large_values(spark):
    schema = "vec_id long, embedding array<double>"
    for rows in ([], [(1, None)], [(1, [1.0, 2.0]), (2, [1.0, 2.0])]):
        assert whitening.whiten(spark.createDataFrame(rows, schema)).count() == 0
    # Rank one; deviations beyond 64 bits; entries beyond them are held at the ends.
    rows = [(k, [k * 1e15, 1e300]) for k in range(5)]
    got = whitening.whiten(spark.createDataFrame(rows, schema)).collect()
    assert {r["component"] for r in got} == {1} and len(got) == 5
    step = 256 * 10**15
    assert {r["vec_id"]: int(r["deviation"]) for r in got} == {k: (5 * k * step - 10 * step) ** 2 for k in range(5)}


def test_packed_vectors():
    for x in ([0], [-32768, 32767], [32768], [-(2**31)], [2**31], [-(2**63), 2**63 - 1]):
        assert whitening.unpacked([whitening.packed(np.array(x, np.int64))]).tolist() == [x]


# --- n-gram Jaccard join -------------------------------------------------------------


def brute_sets(rows, k=4):
    found = []
    for _, text in rows:
        w = words(text)
        found.append({tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set())
    return found


def brute_join(rows, percent=85):
    sets = brute_sets(rows)
    first = list(range(len(rows)))

    def root(i):
        while first[i] != i:
            i = first[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                x, y = root(i), root(j)
                first[max(x, y)] = min(x, y)
    groups: dict[int, list] = {}
    for i in range(len(rows)):
        groups.setdefault(root(i), []).append(rows[i][0])
    name = {c: min((k for k in ids if k is not None), default=None) for c, ids in groups.items()}
    return Counter((rows[i][0], len(sets[i]), name[root(i)]) for i in range(len(rows)))


def families(seed: int, n: int, size: int, change: float) -> list[str]:
    """Texts that grow from each other by changing some words, so that classes are chains."""
    rng, texts = random.Random(seed), []
    for _ in range(n):
        base = [f"v{rng.randrange(3000)}" for _ in range(rng.randrange(5, 120))]
        for _ in range(rng.randrange(1, size)):
            base = [f"e{rng.randrange(10**6)}" if rng.random() < change else w for w in base]
            texts.append(" ".join(base))
    return texts


SMALL = {"group_sets": 3, "group_tokens": 400, "group_queries": 2}


@pytest.mark.parametrize("settings", [{}, SMALL, {**SMALL, "frequent": 5}])
def test_join_equals_brute_force(spark, settings):
    rng = random.Random(2)
    texts = families(5, 30, 8, 0.012)
    line = " ".join(f"w{k}" for k in range(40))
    texts += [f"{line} {t}" for t in texts[:40]]  # a passage that many share
    texts += [f"{line} {line[: 20 * k]}" for k in range(8)]
    texts += rng.sample(texts, 30) + [" \n" + t.upper() + "\t" for t in rng.sample(texts, 10)]
    rows = [*AWKWARD, *((20 + k, t) for k, t in enumerate(texts)), (None, "two words"), (None, "two words"), (400, "a b c"), (401, "A  b c")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = jaccard.classes(df, **settings)
    assert got.columns == ["doc_id", "n_shingles", "component_id"]
    want = brute_join(rows)
    assert Counter(map(tuple, got.collect())) == want
    assert len({c for _, n, c in want if n}) < len(rows) - 60


def test_matrix_joins_what_groups_missed(spark):
    # One family in parts of two sets, a chain: every link but a few is found through the matrix.
    rng = random.Random(8)
    base, texts = [f"v{k}" for k in range(200)], []
    for k in range(30):
        base = [f"e{k}-{i}" if i == rng.randrange(200) else w for i, w in enumerate(base)]
        texts.append(" ".join(base))
    rows = list(enumerate(texts))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = jaccard.classes(df, group_sets=2, group_tokens=1 << 19, group_queries=3)
    assert Counter(map(tuple, got.collect())) == brute_join(rows)


def test_join_of_clashing_and_empty_tables(docs):
    got = jaccard.classes(docs)
    assert Counter(map(tuple, got.collect())) == brute_join(AWKWARD)
    assert jaccard.classes(docs.limit(0)).count() == 0
    only_null = docs.where(F.col("text").isNull())
    assert [tuple(r) for r in jaccard.classes(only_null).collect()] == [(3, 0, 3)]


def test_links_within_connect_all():
    rng = random.Random(1)
    sets = [np.array(sorted(rng.sample(range(40), rng.randrange(1, 12))), np.uint64) for _ in range(60)]
    up = list(range(60))
    for i, j in jaccard.links_within(sets, 50):
        up = [up[i] if u == up[j] else u for u in up]
    want = list(range(60))
    for i in range(60):
        for j in range(i):
            both = len(set(sets[i].tolist()) & set(sets[j].tolist()))
            if 2 * both >= len(sets[i]) + len(sets[j]) - both:
                want = [want[i] if w == want[j] else w for w in want]
    assert len({*zip(up, want)}) == len({*up}) == len({*want}) < 60
