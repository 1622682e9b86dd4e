"""The registered queries against their SQL, and the pipeline against a plain version."""

from __future__ import annotations

import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as driver
from checks import compare
from shopgrain.llm import queries, secrets, toxicity
from tests.conftest import SF
from tests.llm.test_operators import brute_classes, brute_print
from tests.llm.test_sampling_whitening_joins import brute_join, brute_whiten


def test_all_queries_are_registered():
    found = driver.queries()
    assert {f"op{n}" for n in range(1, 14)} <= {k.split("_")[0] for k in found}
    assert "pipeline" in found and set(queries.ORACLE) <= set(queries.QUERIES)


@pytest.mark.parametrize("key", sorted(queries.ORACLE))
def test_sql(spark, key, monkeypatch):
    monkeypatch.setattr(compare, "QUERIES", queries.QUERIES)
    monkeypatch.setattr(compare, "ORACLE", queries.ORACLE)
    assert compare.compare(spark, compare.duck(SF), SF, key) == ""


@pytest.mark.parametrize("key", sorted(set(queries.QUERIES) - set(queries.ORACLE) - {"op12_embedding_whitening"}))
def test_one_row_per_document(spark, key):
    ids = Counter(r["doc_id"] for r in queries.QUERIES[key](spark, SF).select("doc_id").collect())
    assert ids == Counter(r["doc_id"] for r in queries.table(spark, SF, "documents").select("doc_id").collect())


def test_token_groups_of_the_whole_table(spark):
    rows = [(r["doc_id"], r["text"]) for r in queries.table(spark, SF, "documents").collect()]
    got = Counter(map(tuple, queries.QUERIES["op13_token_groups"](spark, SF).collect()))
    assert got == brute_join(rows)
    assert len({c for _, _, c in got}) < len(rows)


def test_whitening_of_the_whole_table(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in queries.table(spark, SF, "embeddings").collect()]
    got = queries.QUERIES["op12_embedding_whitening"](spark, SF)
    assert dict(got.dtypes)["deviation"] == "bigint"
    kept, n, deviation, white, explained = brute_whiten(rows, 4)
    found = {(r["vec_id"], r["component"]): r for r in got.collect()}
    assert len(found) == 4 * len(kept)
    for i, x in kept:
        for c in range(4):
            r = found[i, c + 1]
            assert r["n"] == n and r["deviation"] == deviation[tuple(x)] and r["identity_error"] < 1e-4
            assert abs(r["whitened"]) == pytest.approx(abs(white[tuple(x)][c]), abs=1e-7)
            assert r["explained"] == pytest.approx(explained[c], rel=1e-9)


def test_pipeline(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    docs = queries.table(spark, SF, "documents")
    model = toxicity.learn(docs, queries.table(spark, SF, "labels"))
    scores = {r["doc_id"]: r["score"] for r in toxicity.score(docs, model).collect()}
    texts = {r["doc_id"]: r["text"] for r in docs.collect() if scores[r["doc_id"]] < 0.3}
    ids = sorted(texts)
    classes = brute_classes([brute_print(texts[i]) for i in ids], 4)
    texts = {i: texts[i] for n, i in enumerate(ids) if classes[n] == n}

    def split(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.lower() if t.isascii() else "".join(c.lower() if c.isascii() else c for c in t))

    windows = set()
    for r in queries.table(spark, SF, "benchmark").collect():
        w = split(r["text"])
        windows |= {tuple(w[i : i + 10]) for i in range(max(1, len(w) - 9))} if w else set()
    sizes = {len(w) for w in windows}

    def hit(t):
        w = split(t)
        return any(tuple(w[i : i + k]) in windows for k in sizes for i in range(len(w) - k + 1))

    texts = {i: t for i, t in texts.items() if not hit(t)}
    want = {i: secrets.masked(t, [s[1:] for s in secrets.scan(t)], "[SECRET]") for i, t in texts.items()}
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, SF).collect()}
    assert set(got) == set(want)
    for i, t in want.items():
        assert got[i]["round_trip"] and got[i]["n_chars"] == len(t) and len(got[i]["ids"]) == got[i]["n_tokens"]
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash_copies", "decontamination", "secrets", "tokens"]


def test_stages_leave_extra_columns_alone(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    docs = queries.table(spark, SF, "documents").limit(60)
    names = ["node", "_k", "_score", "score", "spans", "items", "hits", "n_hit", "n_words", "fingerprint", "row_hash", "decoded", "ids", "rest"]
    docs = docs.withColumns({n: F.concat(F.lit(n), "doc_id") for n in names}).cache()
    want = {r["doc_id"]: r.asDict() for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, SF)
        assert kept.columns == docs.columns, name
        rows = [r.asDict() for r in kept.collect()]
        assert rows, name
        for r in rows:
            assert {n: r[n] for n in names} == {n: want[r["doc_id"]][n] for n in names}, name
    assert corpus_pipeline.tokens(spark, docs, SF).count() == 60


def test_stages_of_an_empty_table(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    docs = queries.table(spark, SF, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES[1:]:
        assert stage(spark, docs, SF).count() == 0
