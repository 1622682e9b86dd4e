"""The operators against brute force, on small tables with awkward rows.

``AWKWARD`` has a null text, a null id, empty and white texts, repeated rows, long texts
and extra columns whose names clash with those of the operators.
"""

from __future__ import annotations

import base64
import hashlib
import math
import random
import re
import sys
import time
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
import zstandard
from pyspark.sql import functions as F

from shopgrain.llm import (
    bpe,
    decontaminate,
    frequent,
    kneser_ney,
    quality,
    secrets,
    sharding,
    simhash,
    suffix_dedup,
    toxicity,
    warc,
)

SCHEMA = "doc_id long, text string, lang string, spans string, score string, shard string, n_words string"
WORDS = "alpha beta gamma delta éclair zürich one two three four five six seven eight nine ten".split()


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) for _ in range(n))


PASSAGE = prose(99, 60)
AWKWARD = [
    (0, prose(0, 80)),
    (1, prose(1, 40) + " " + PASSAGE + " " + prose(2, 30)),
    (2, PASSAGE),
    (3, None),
    (4, ""),
    (5, " \t\n\x0b\x0c\r "),
    (6, prose(1, 40) + " " + PASSAGE + " " + prose(2, 29) + " other"),
    (7, "a" * 900),
    (8, prose(0, 80)),
    (8, prose(0, 80)),
    (9, prose(3, 3000)),
    (None, PASSAGE + " " + PASSAGE),
    (10, "x"),
    (11, "É é　  <|endoftext|> 中文 \U0001f600 it's\n\n  don't"),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", "clash", "clash", "clash", "clash") for i, t in AWKWARD]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def nothing(docs):
    return docs.limit(0)


def words(text: str | None) -> list[str]:
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", low)


# --- repeated strings ----------------------------------------------------------------


def brute_spans(rows: list[tuple[int, bytes]], size: int) -> dict[int, list[bool]]:
    seen: dict[bytes, tuple] = {}
    gone = {}
    for i, data in rows:
        mark = [False] * len(data)
        for s in range(len(data) - size + 1):
            first = seen.setdefault(data[s : s + size], (i, s))
            if first != (i, s):
                mark[s : s + size] = [True] * size
        gone[i] = mark
    return gone


@pytest.mark.parametrize("task_runs", [2, 4096])
def test_repeated_strings(spark, task_runs):
    rng = random.Random(5)
    shared = [prose(k, 40) for k in range(6)]
    rows = []
    for i in range(60):
        parts = [rng.choice(shared) if rng.random() < 0.5 else prose(1000 + 7 * i + k, 30) for k in range(4)]
        rows.append((i, (" " * rng.randint(1, 3)).join(parts)))
    rows += [(60, "ab" * 400), (61, "ab" * 60), (62, ""), (63, "short")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    settings = suffix_dedup.Settings(task_runs=task_runs, strip_bytes=2000)
    got = {r["doc_id"]: r for r in suffix_dedup.digest(suffix_dedup.repeated(df, settings)).collect()}
    want = brute_spans([(i, t.encode()) for i, t in rows], 100)
    assert sum(map(sum, want.values())) > 5000
    for i, text in rows:
        mark, data = want[i], text.encode()
        kept = bytes(b for b, m in zip(data, mark) if not m)
        runs = sum(m and not (k and mark[k - 1]) for k, m in enumerate(mark))
        assert got[i].asDict() == {
            "doc_id": i,
            "n_bytes": len(data),
            "n_removed": sum(mark),
            "n_spans": runs,
            "kept_sha256": hashlib.sha256(kept).hexdigest(),
        }


def test_repeated_strings_of_awkward_rows(docs, nothing):
    rows = suffix_dedup.digest(suffix_dedup.repeated(docs)).collect()
    assert len(rows) == len(AWKWARD)
    by_id: dict = {}
    for r in rows:
        by_id.setdefault(r["doc_id"], []).append(r)
    assert by_id[3][0]["n_bytes"] == by_id[4][0]["n_bytes"] == 0
    assert by_id[2][0]["n_removed"] == len(PASSAGE.encode())  # the null id comes first
    assert [r["n_removed"] for r in by_id[8]] == [len(AWKWARD[0][1].encode())] * 2
    assert by_id[7][0]["n_removed"] == 899
    assert suffix_dedup.digest(suffix_dedup.repeated(nothing)).count() == 0


# --- web archives --------------------------------------------------------------------


@pytest.fixture(scope="module")
def pages(spark):
    html = ["<p>one</p>", "<p>two</p>", "<p>one</p>", None, "", "é" * 5000, "a\r\n\r\nb", "<p>one</p>"]
    rows = [(i, None if i == 1 else f"http://x/{i}\r\nEvil: 1", h, "clash") for i, h in enumerate(html)]
    return spark.createDataFrame([*rows, (None, "u", "<p>two</p>", "x")], "page_id long, url string, html string, sha string")


def test_archives_round_trip(pages):
    bundles = warc.write_bundles(warc.with_first(pages), frame_bytes=300, bundle_bytes=4000).cache()
    got = {r["record_id"]: r for r in warc.read_bundles(bundles).collect()}
    assert len(got) == 9
    want = {0: None, 1: None, 2: 0, 3: None, 4: 3, 5: None, 6: None, 7: 0, None: 1}
    assert {i: r["refers_to"] for i, r in got.items()} == want
    for r in pages.collect():
        data, rec = (r["html"] or "").encode(), got[r["page_id"]]
        assert rec["payload_bytes"] == len(data)
        assert rec["payload_digest"] == base64.b32encode(hashlib.sha1(data).digest()).decode()
        assert rec["record_type"] == ("response" if want[r["page_id"]] is None else "revisit")
        assert rec["payload"] == (data if rec["record_type"] == "response" else None)
    assert got[1]["url"] is None and "\n" not in got[0]["url"]
    found = warc.lookup(bundles, pages.where("page_id in (5, 7)").select(F.col("page_id").alias("record_id")))
    assert {r["record_id"] for r in found.collect()} == {5, 7}
    # Any reader unpacks a bundle; the seek table is skipped.
    archive = bundles.first()["archive"]
    assert zstandard.ZstdDecompressor().stream_reader(archive, read_across_frames=True).read().startswith(b"WARC/1.1\r\n")
    assert warc.read_bundles(warc.write_bundles(warc.with_first(pages.limit(0)))).count() == 0


def test_damaged_record_is_told():
    data = warc.record(1, "u", b"abc", warc.digest_of(b"abc"), 1, False)
    with pytest.raises(ValueError, match="damaged"):
        warc._unpacked(data.replace(b"\r\nabc", b"\r\nabd").replace(b"\n\r\nabc", b"\n\r\nabd"))


# --- near copies ---------------------------------------------------------------------


def brute_print(text: str | None, k: int = 4) -> int:
    w = words(text)
    shingles = [" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))] if w else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_classes(values: list[int], budget: int) -> list[int]:
    up = list(range(len(values)))

    def root(i: int) -> int:
        while up[i] != i:
            i = up[i]
        return i

    for i, a in enumerate(values):
        for j in range(i):
            if (a ^ values[j]).bit_count() <= budget:
                x, y = root(i), root(j)
                up[max(x, y)] = min(x, y)
    return [root(i) for i in range(len(values))]


def test_fingerprints_and_classes(docs, nothing):
    rows = simhash.classes(docs).withColumn("fingerprint", simhash.hex_fingerprint()).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"], r["fingerprint"]) for r in rows if r["doc_id"] is not None) == sorted(
        (False, i, f"{brute_print(t):016x}") for i, t in AWKWARD if i is not None
    )
    component = {r["doc_id"]: r["component_id"] for r in rows}
    assert component[3] == component[4] == component[5] == 3
    assert component[8] == 0
    assert simhash.classes(nothing).count() == 0


@pytest.mark.parametrize("task_rows", [8, 8192])
def test_trie_join_of_clusters(spark, task_rows):
    rng = random.Random(3)
    values = []
    for _ in range(40):
        centre = rng.getrandbits(64)
        values.append(centre)
        for _ in range(rng.choice([0, 1, 30])):
            values.append(centre ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 6))))
    values = sorted(set(values))
    df = spark.createDataFrame([(v - (1 << 64) if v >> 63 else v,) for v in values], "fingerprint long")
    stars = simhash.components(simhash.links(df, 4, task_rows=task_rows, head_rows=1))
    got = {r["node"] % (1 << 64): r["component"] % (1 << 64) for r in stars.collect()}
    want = brute_classes(values, 4)
    groups = Counter(want)
    ours = {}
    for v, c in zip(values, want):
        if groups[c] == 1:
            assert v not in got
        else:
            assert ours.setdefault(c, got.get(v, v)) == got.get(v, v)
    assert len(set(ours.values())) == len(ours) > 10


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (100, 101)], "a long, b long")
    got = {r["node"]: r["component"] for r in simhash.components(edges).collect()}
    assert got == {i: 0 for i in range(1, 41)} | {101: 100}


def brute_first(rows: list[tuple]) -> Counter:
    """Texts of the rows that stay, one of each class of fingerprints within four bits."""
    first = brute_classes([brute_print(r[1]) for r in rows], 4)
    groups: dict[int, list] = {}
    for i, c in enumerate(first):
        groups.setdefault(c, []).append(rows[i][0])
    return Counter(min(ids, key=lambda k: (k is not None, k or 0)) for ids in groups.values())


def test_first_copies_keeps_one_of_each_group(docs, nothing):
    kept = simhash.first_copies(docs)
    assert kept.columns == docs.columns
    assert Counter(r["doc_id"] for r in kept.collect()) == brute_first(AWKWARD)
    assert simhash.first_copies(nothing).count() == 0


def test_first_copies_with_null_and_repeated_ids(spark):
    texts = [prose(100 + k, 60) for k in range(6)]
    rows = [(i, t) for i in (None, 7) for t in texts] + [(None, texts[2]), (8, " \n" + texts[3])]
    rows += [(8, prose(300, 60)), (8, prose(300, 60)), (9, None), (10, ""), (9, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    kept = simhash.first_copies(df).collect()
    assert Counter(r["doc_id"] for r in kept) == brute_first(rows)
    assert Counter(r["doc_id"] for r in kept)[9] == 1


def test_first_copies_leaves_columns_of_any_name_alone(spark):
    names = ["node", "key", "mark", "row_hash", "ROW_HASH_", "fingerprint", "component", "least", "first_key", "first_mark"]
    rows = [(k, prose(k // 2, 50), *(f"{n} {k}" for n in names)) for k in range(10)]
    df = spark.createDataFrame(rows, ", ".join(["doc_id long", "text string", *(f"{n} string" for n in names)]))
    kept = simhash.first_copies(df)
    assert kept.columns == df.columns
    assert sorted(map(tuple, kept.collect())) == rows[::2]


# --- quality -------------------------------------------------------------------------


def test_base_figures(docs, nothing):
    got = {r["doc_id"]: r for r in quality.judge(docs).collect()}
    for i, text in AWKWARD:
        w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        tri = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
        times, covered = Counter(tri), set()
        for k, t in enumerate(tri):
            if times[t] > 1:
                covered |= {k, k + 1, k + 2}
        seen, again = set(), 0
        for line in (text or "").split("\n"):
            if re.search(r"[^\x20\x09-\x0D]", line):
                again += line in seen
                seen.add(line)
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_dup_lines"], r["n_repeat_words"]) == (
            len(w), sum(map(len, w)), again, len(covered),
        )
        assert r["n_symbols"] == len(re.findall(r"[#*$%&|<>]", text or ""))
        assert r["base_failed"] == (len(w) < 50 or 100 * len(covered) > 50 * len(w))
        assert not (r["kept"] and r["base_failed"])
    assert quality.judge(nothing).count() == 0


def test_distance_of_histograms():
    p, q = np.array([[1.0, 0, 3], [0, 5, 0], [2, 0, 6]]), np.array([1.0, 0, 3])
    assert quality.distance(p, q).tolist() == pytest.approx([0, 1, 0])


def test_divergent_text_is_not_kept(spark):
    rng = random.Random(8)
    common = "the of and to in is it".split()
    clean = [" ".join(rng.choice(common if rng.random() < 0.4 else WORDS) for _ in range(120)) + "." for _ in range(150)]
    junk = [" ".join(w + "%%%" for w in t.split()) for t in clean[:4]] + [t.upper() + "!!" for t in clean[4:8]]
    rows = [(i, t, "en") for i, t in enumerate(clean + junk)]
    got = quality.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    assert all(r["kept"] == (r["doc_id"] < 150) for r in got)


# --- tokens --------------------------------------------------------------------------


def tokenizer():
    public = pytest.importorskip("public_tokenizers")
    tokenizers = pytest.importorskip("tokenizers")
    path = public.path("byte_bpe_50k.json")
    return path, tokenizers.Tokenizer.from_file(path)


@pytest.mark.parametrize("chunks", [0, 8, 4096])
def test_tokens_equal_the_library(docs, nothing, chunks):
    path, reference = tokenizer()
    rows = bpe.decode(bpe.encode(docs, path, lexicon_chunks=chunks), path).collect()
    assert len(rows) == len(AWKWARD)
    for r in rows:
        ids = reference.encode(r["text"] or "", add_special_tokens=False).ids
        assert r["ids"] == ids
        assert r["decoded"] == reference.decode(ids, skip_special_tokens=False) == (r["text"] or "")
    if not chunks:
        digest = bpe.digest(bpe.decode(bpe.encode(nothing, path), path))
        assert digest.count() == 0


def test_long_words_merge_alike():
    path, reference = tokenizer()
    vocabulary = bpe.Vocabulary.read(path)
    rng = random.Random(1)
    for n in (47, 48, 49, 300, 2000):
        word = "".join(rng.choice("abcdeé") for _ in range(n))
        ids = reference.encode(word, add_special_tokens=False).ids
        assert vocabulary.merge(word.encode()) == ids
        raw = [vocabulary.singles[b] for b in word.encode()]
        assert vocabulary._short(list(raw)) == vocabulary._long(list(raw)) == ids


def test_bytes_that_are_no_text_decode_to_the_mark(spark):
    path, reference = tokenizer()
    ids = reference.encode("é", add_special_tokens=False).ids[:1]
    vocabulary = bpe.Vocabulary.read(path)
    cut = [vocabulary.singles[0xC3]]
    df = spark.createDataFrame([(ids + cut,), (None,), ([],)], "ids array<int>")
    got = [r["decoded"] for r in bpe.decode(df, path).collect()]
    assert got == [reference.decode(ids + cut, skip_special_tokens=False), "", ""]


def test_lexicon_is_a_minimal_automaton():
    keys = {w.encode(): [k, k + 1] for k, w in enumerate(["", "a", "tap", "taps", "top", "tops", "stop", "stops", "été"])}
    lexicon = bpe.Lexicon(bpe.compile_lexicon(keys))
    for key, ids in keys.items():
        assert lexicon.lookup(key).tolist() == ids
        assert lexicon.rank(key) == sorted(keys).index(key)
    for missing in ("t", "tapss", "sto", "b", "\xe9", "stopsx"):
        assert lexicon.lookup(missing.encode()) is None
    assert len(lexicon._final) < sum(map(len, keys))


def test_most_frequent_with_ties(spark):
    rows = [("en", f"w{k}", 1 + k // 3) for k in range(50)] + [("fr", "x", 7)]
    df = spark.createDataFrame(rows, "language string, word string, n long")
    best = sorted(rows[:50], key=lambda r: (-r[2], r[1]))[:7]
    got = frequent.most_frequent(df, "word", 7, "language")
    assert {(r["language"], r["word"], r["n"]) for r in got} == {*best, rows[50]}
    assert [r["word"] for r in frequent.most_frequent(df.where("language = 'en'"), "word", 7)] == [r[1] for r in best]
    assert frequent.most_frequent(df.limit(0), "word", 7) == []


# --- toxicity ------------------------------------------------------------------------


def test_grammar_marks_clauses():
    grammar = toxicity.Grammar({"idiot": 3.0, "mor*": 2.0})

    def kinds(text: str) -> list[int]:
        return [k for k, _ in grammar.matches(text)]

    insult, threat, targeted, negated, reported = 1, 2, 4, 8, 16
    assert kinds("an idiot") == [insult]
    assert kinds("you idiot, morons") == [insult + targeted, insult]
    assert kinds("you are not an idiot") == [insult + targeted + negated]
    assert kinds("he said idiot. idiot") == [insult + targeted + reported, insult]
    assert kinds("we will kill you") == [threat + targeted] and kinds("kill. you") == [threat]
    assert kinds("idiot idiot you") == [insult + targeted] and kinds("idiot a b c d you") == [insult]
    assert kinds("nothing here") == [] and kinds("") == []


def test_grammar_against_a_plain_reading():
    """Kinds and weights by looking at the words around each match, without automata."""
    rng = random.Random(11)
    grammar = toxicity.Grammar({"idiot": 3.0, "mor*": 2.0}, {"maul": 1.5})
    weights = {"idiot": (1, 3.0), "moron": (1, 2.0), "maul": (2, 1.5), "kill": (2, 1.0)}
    pool = [*weights, "you", "not", "said", "tree", "stone", ",", ".", "\n"]
    for _ in range(400):
        words = [rng.choice(pool) for _ in range(rng.randint(0, 30))]
        want, clause = [], []
        for word in [*words, "."]:
            if word not in (",", ".", "\n"):
                clause.append(word)
                continue
            kinds = {}
            for i, w in enumerate(clause):
                if w in weights:
                    kind, weight = weights[w]
                    near = clause[max(i - 4, 0) : i] + clause[i + 1 : i + 5]
                    kind += 4 * ("you" in near) + 8 * ("not" in clause[max(i - 3, 0) : i]) + 16 * ("said" in clause[:i])
                    kinds[kind] = kinds.get(kind, 0) + weight
            want += kinds.items()
            clause = []
        assert grammar.matches(" ".join(words)) == want


def test_threats_are_learned_by_where_their_target_stands(spark):
    rows = [(i, f"w{i} we will grabble you soon", 1) for i in range(0, 60, 3)]
    rows += [(i, f"w{i} you snollygoster there", 1) for i in range(1, 60, 3)]
    rows += [(i, f"w{i} we will meet you there soon", 0) for i in range(2, 60, 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.learn(docs, docs.select("doc_id", "toxic"))
    assert "grabble" in model.threats and "snollygoster" in model.insults
    assert not set(model.threats) & set(model.insults)


def test_no_feature_adds_up_across_stances():
    grammar = toxicity.Grammar({"idiot": 3.0})
    texts = ["you idiot", "idiot", "not you idiot", "he said you idiot"]
    used = [{i for i, v in enumerate(grammar.features(t)) if v} for t in texts]
    assert all(used) and not any(a & b for n, a in enumerate(used) for b in used[:n])
    assert all(len(grammar.features(t)) == toxicity.FEATURES for t in [*texts, ""])


def test_scores_of_awkward_rows(spark, docs, nothing):
    labels = spark.createDataFrame([(i, i % 2) for i in range(12)] + [(0, 1), (None, 1), (5, None)], "doc_id long, toxic int")
    model = toxicity.learn(docs, labels, min_rows=1, min_odds=0.1)
    scores = {r["doc_id"]: r["score"] for r in toxicity.score(docs, model).collect()}
    assert all(0 <= s <= 1 for s in scores.values()) and scores[3] == scores[4]
    flat = toxicity.learn(docs, labels.limit(0))
    assert not flat.insults
    assert toxicity.score(nothing, model).count() == 0


def test_held_out_accuracy(spark):
    rng = random.Random(2)
    insults = ["foulword", "badness"]
    rows, labels = [], []
    for i in range(600):
        toxic = rng.random() < 0.2
        text = [rng.choice(WORDS) for _ in range(60)]
        if toxic:
            text[rng.randrange(60)] = rng.choice(insults)
        rows.append((i, " ".join(text)))
        labels.append((i, int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = toxicity.learn(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    held = toxicity.score(docs, model).where(toxicity.held_out()).collect()
    assert len(held) > 100
    assert all((r["score"] >= 0.3) == bool(labels[r["doc_id"]][1]) for r in held)
    assert {r["doc_id"] for r in held} == {i for i, _ in rows if zlib.crc32(str(i).encode()) % 4 == 2}


# --- shards --------------------------------------------------------------------------


@pytest.mark.parametrize("fanout", [4, 1024])
def test_shards_are_near_equal_and_gapless(spark, fanout):
    rng = random.Random(4)
    rows = [(i * i * 977, "x" * rng.randint(0, 300)) for i in range(900)]
    rows += [(5, "hot")] * 400 + [(None, None)] * 5 + [(-(2**62), "a"), (2**62, "b")]
    out = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string"), shards=6, fanout=fanout).collect()
    assert len(out) == len(rows)
    size = Counter()
    for r in out:
        size[r["shard"]] += r["size"]
    assert sorted(size) == list(range(6))
    assert max(size.values()) - min(size.values()) <= 2 * 308
    for k in range(6):
        own = sorted((r for r in out if r["shard"] == k), key=lambda r: r["slot"])
        assert [r["slot"] for r in own] == list(range(len(own)))
        ids = [-(2**63) if r["doc_id"] is None else r["doc_id"] for r in own]
        assert ids == sorted(ids)
    assert all(r["text_crc32"] == zlib.crc32((b"hot")) for r in out if r["doc_id"] == 5)


def test_cuts_equal_brute_force(spark):
    """Every cut is the border of rows nearest to its target, or within the tolerance."""
    rng = random.Random(11)
    for keys in ([rng.getrandbits(64) - 2**63 for _ in range(3000)], [rng.randrange(40) for _ in range(500)], [-(2**63), 2**63 - 1, 0]):
        sizes = [rng.randint(1, 50) for _ in keys]
        rows = spark.createDataFrame([(k, i, s) for i, (k, s) in enumerate(zip(keys, sizes))], "_major long, _minor long, size long").cache()
        for cuts in (1, 7, 100):
            got = sharding.splitters(rows, cuts, tolerance=0.0)
            order = sorted(zip(keys, range(len(keys)), sizes))
            borders = np.concatenate([[0], np.cumsum([s for *_, s in order])])
            for i, c in enumerate(got):
                target = borders[-1] * (i + 1) / (cuts + 1)
                below = sum(s for k, m, s in order if (k, m) < (c.major, c.minor))
                assert abs(below - target) == pytest.approx(np.abs(borders - target).min()), (cuts, i)


def test_many_cuts_of_wide_keys(spark):
    """Two thousand cuts over random 64-bit keys; the plan has no branch for each."""
    rows = spark.range(0, 50_000, 1, 8).select(
        F.xxhash64("id").alias("_major"), F.col("id").alias("_minor"), (F.col("id") % 90 + 10).alias("size")
    ).cache()
    total = rows.agg(F.sum("size")).first()[0]
    started = time.time()
    cuts = sharding.splitters(rows, 2000)
    assert time.time() - started < 60  # some ten seconds on an idle machine
    placed = rows.withColumn("cell", sharding._passed(cuts)).groupBy("cell").agg(F.sum("size").alias("n")).collect()
    assert len(cuts) == 2000 and len(placed) == 2001
    assert max(abs(r["n"] - total / 2001) for r in placed) <= 100


def test_shards_of_awkward_rows(docs, nothing):
    out = sharding.shard(docs).collect()
    assert len(out) == len(AWKWARD)
    assert sorted(r["size"] for r in out) == sorted(len((t or "").encode()) + 8 for _, t in AWKWARD)
    assert sharding.shard(nothing).count() == 0


def test_shards_hold_whole_rows(spark, docs, nothing):
    """Texts and other columns move with their row; the checksum is of the text that moved."""
    named = docs.withColumn("a.b", F.concat(F.lit("row "), F.col("doc_id")))
    out = sharding.shard(named, shards=3)
    assert out.columns == ["doc_id", "text", "lang", "spans", "score", "n_words", "a.b", *sharding.PLACE]
    rows = out.collect()
    assert Counter((r["doc_id"], r["text"], r["a.b"]) for r in rows) == Counter(
        (i, t, None if i is None else f"row {i}") for i, t in AWKWARD
    )
    assert all(r["text_crc32"] == zlib.crc32((r["text"] or "").encode()) and r["lang"] == "en" for r in rows)
    assert sharding.shard(named.select("doc_id", "text")).columns == ["doc_id", "text", *sharding.PLACE]
    assert sharding.shard(nothing).columns[:2] == ["doc_id", "text"]
    dealt = re.findall(r"Exchange hashpartitioning\(_cell#.*\n.*Project \[(.*?)\]", out._jdf.queryExecution().executedPlan().toString())
    assert any("text#" in columns for columns in dealt)


# --- benchmark passages --------------------------------------------------------------


def brute_hits(text: str | None, items: list[tuple], window: int) -> tuple[int, int, list[str]]:
    def split(t):
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)

    w, hit, ids = split(text), set(), set()
    for item, body in items:
        b = split(body)
        for i in range(max(1, len(b) - window + 1) if b else 0):
            part = b[i : i + window]
            for at in range(len(w) - len(part) + 1):
                if w[at : at + len(part)] == part:
                    hit |= set(range(at, at + len(part)))
                    ids.add("" if item is None else str(item))
    return len(w), len(hit), sorted(ids)


@pytest.mark.parametrize("block_bytes", [1, 4 << 20])
def test_benchmark_passages(spark, docs, nothing, block_bytes):
    items = [(1, PASSAGE[10:200]), (20, "Zürich-ONE"), (3, None), (4, "?!"), (5, prose(0, 80)), (5, prose(0, 80)), (None, prose(3, 12))]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.find(docs, benchmark, block_bytes=block_bytes)
    got = decontaminate.digest(found).collect()
    assert len(got) == len(AWKWARD)
    texts = {i: t for i, t in AWKWARD}
    for r in got:
        n, hit, ids = brute_hits(texts[r["doc_id"]], items, 10)
        assert (r["n_words"], r["n_hit"], r["n_items"]) == (n, hit, len(ids))
        assert r["items_sha256"] == hashlib.sha256(",".join(ids).encode()).hexdigest()
        assert r["contaminated"] == (hit > 0)
    assert decontaminate.find(docs, benchmark.limit(0)).where("n_hit > 0").count() == 0
    assert decontaminate.find(nothing, benchmark).count() == 0


# --- secrets -------------------------------------------------------------------------


def brute_secrets(text: str) -> list[tuple[str, int, int]]:
    low = "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in "password|passwd|secret|token|api_?key")
    assign = rf"""(?:{low})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    found = [("assign", *m.span()) for m in re.finditer(assign, text) if len(m[1]) >= 6]
    found += [("access", *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [("hex", *m.span()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(found, key=lambda s: (s[1], secrets.KINDS.index(s[0])))


def test_base_secrets_equal_plain_patterns():
    rng = random.Random(6)
    bits = ["token", "secret", "Api_Key", "APIKEY", "passwd", "PASSWORD", "=", ":", " ", '"', "'", "abc", "abcdef12", "0f" * 13, "AKIA", "Z9" * 9, "ſ", "\n", "é"]
    for _ in range(3000):
        text = "".join(rng.choice(bits) for _ in range(rng.randint(1, 14)))
        got = [s for s in secrets.scan(text) if s[0] in secrets.BASE]
        assert got == brute_secrets(text), text


def test_checksums_decide():
    body = "A1b2C3d4E5f6G7h8I9j0K1l2M3n4O5"
    n, check = zlib.crc32(body.encode()), ""
    while n or len(check) < 6:
        check, n = secrets._BASE62[n % 62] + check, n // 62
    good = f"see ghp_{body}{check} end"
    assert secrets.scan(good) == [("vcs", 4, 44)]
    assert secrets.scan(good.replace("A1b2", "A1b3")) == []
    assert [s[0] for s in secrets.scan("card no. 4111 1111 1111 1111.")] == ["card"]
    assert secrets.scan("card no. 4111 1111 1111 1112.") == []
    assert secrets.scan("IBAN GB82 WEST 1234 5698 7654 32 AND MORE") == [("iban", 5, 32)]
    assert secrets.scan("IBAN GB82 WEST 1234 5698 7654 33") == []


def test_spans_and_masks(spark, docs, nothing):
    rows = [(1, 'my token = "abcdef123456" ok'), (2, None), (3, "clean"), (4, "secret:" + "0123456789abcdef" * 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = secrets.find(df)
    got = {r["doc_id"]: r for r in secrets.digest(found).collect()}
    assert (got[1]["n_assign"], got[1]["n_hex"], got[1]["spans"]) == (1, 0, "assign:3:24")
    assert got[1]["base_sha256"] == hashlib.sha256(b"assign:3:24").hexdigest()
    assert got[4]["spans"] == "assign:0:39,hex:7:39"
    texts = {r["doc_id"]: r["text"] for r in secrets.mask(found).collect()}
    assert texts == {1: 'my [SECRET]" ok', 2: None, 3: "clean", 4: "[SECRET]"}
    assert secrets.digest(secrets.find(docs)).count() == len(AWKWARD)
    assert secrets.find(nothing).count() == 0


# --- language model ------------------------------------------------------------------


def brute_model(texts: list[str | None]):
    seqs = [[w.encode() for w in words(t)] for t in texts]
    c, b = Counter(), Counter()
    for w in seqs:
        c.update(w + [b""])
        b.update(zip([None, *w], [*w, b""]))
    n, v = sum(c.values()), len(c)
    high = kneser_ney.discounts([sum(x == k for x in b.values()) for k in (1, 2, 3, 4)])
    cont = Counter(w for _, w in b)
    low = kneser_ney.discounts([sum(x == k for x in cont.values()) for k in (1, 2, 3, 4)])

    def d(k, table):
        return 0 if not k else table[min(k, 3) - 1]

    mass = sum(d(x, low) for x in cont.values()) / len(b)

    def p(h, w):
        small = (cont[w] - d(cont[w], low)) / len(b) + mass / (v + 1)
        after = [x for (g, _), x in b.items() if g == h]
        if not after:
            return small
        return (b[h, w] - d(b[h, w], high)) / sum(after) + sum(d(x, high) for x in after) / sum(after) * small

    return c, n, v, p


@pytest.mark.parametrize("shard_tokens", [50, 4_000_000])
def test_model_equals_brute_force(spark, docs, nothing, shard_tokens):
    learned = docs.where("doc_id < 9 or doc_id is null")
    model = kneser_ney.train(learned, shard_tokens=shard_tokens)
    c, n, v, p = brute_model([t for i, t in AWKWARD if i is None or i < 9])
    assert (model.vocabulary.tokens, model.vocabulary.size) == (n, v)
    texts = {i: t for i, t in AWKWARD}
    for r in kneser_ney.score(docs, model).collect():
        w = [x.encode() for x in words(texts[r["doc_id"]])]
        seq = [*w, b""]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(seq), sum(x in c for x in seq), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in seq))
        if len(seq) < 200:
            assert r["score"] == pytest.approx(sum(math.log10(p(h, x)) for h, x in zip([None, *w], seq)))
    assert kneser_ney.score(nothing, model).count() == 0
    empty = kneser_ney.train(nothing)
    assert {r["score"] for r in kneser_ney.score(docs, empty).collect()} == {0.0}


def test_probabilities_sum_to_one():
    c, _, _, p = brute_model([prose(1, 50), prose(2, 30)])
    assert sum(p(b"one", w) for w in [*c, b"unknown"]) == pytest.approx(1)


@pytest.mark.parametrize("order, shard_tokens", [(3, 20), (3, 4_000_000), (4, 50)])
def test_longer_histories_equal_brute_force(spark, docs, nothing, order, shard_tokens):
    learned = [t for i, t in AWKWARD if i is None or i < 9]
    grams = Counter()
    for t in learned:
        w = [None] * (order - 1) + words(t) + [""]
        grams.update(tuple(w[k - order + 1 : k + 1]) for k in range(order - 1, len(w)))
    levels = [grams]
    while len(next(iter(levels[0]))) > 1:
        levels.insert(0, Counter(g[1:] for g in levels[0]))
    cut = [kneser_ney.discounts([sum(x == k for x in c.values()) for k in (1, 2, 3, 4)]) for c in levels]
    after = [{} for _ in levels]
    for c, a in zip(levels, after):
        for g, x in c.items():
            a.setdefault(g[:-1], []).append(x)

    def p(g):
        n = len(g) - 1
        shorter = p(g[1:]) if n else 1 / (len(levels[0]) + 1)
        followers = after[n].get(g[:-1])
        if not followers:
            return shorter
        d = [0, *cut[n]]
        x = levels[n][g]
        return (x - d[min(x, 3)]) / sum(followers) + sum(d[min(f, 3)] for f in followers) / sum(followers) * shorter

    model = kneser_ney.train(docs.where("doc_id < 9 or doc_id is null"), shard_tokens=shard_tokens, order=order)
    texts = dict(AWKWARD)
    for r in kneser_ney.score(docs, model).collect():
        w = [None] * (order - 1) + words(texts[r["doc_id"]]) + [""]
        want = sum(math.log10(p(tuple(w[k - order + 1 : k + 1]))) for k in range(order - 1, len(w)))
        assert r["score"] == pytest.approx(want)
    assert {r["score"] for r in kneser_ney.score(docs, kneser_ney.train(nothing, order=order)).collect()} == {0.0}


def test_tokens_and_their_hashes_equal_plain_python():
    rng = random.Random(10)
    bits = [b" ", b"\t", b"\n", b"\x0b", b"\x0c", b"\r", b"A", b"z", b"[", b"\x00", b"\x1c", b"\x85", b"\xff", "\u2003\u00c4".encode()]
    texts = [None, b"", b" ", b"a", b" a", b"a ", b"\n\n A  b\n", *(b"W" * k for k in (31, 32, 33, 500))]
    texts += [b"".join(rng.choices(bits, k=rng.randrange(60))) for _ in range(500)]
    texts += [b" ".join(rng.randbytes(rng.randrange(45)) for _ in range(20)) for _ in range(50)]
    want = [[*(t or b"").lower().split(), b""] for t in texts]
    for given in (pa.array(texts, pa.binary()), pa.array([b"x y", *texts], pa.large_binary()).slice(1)):
        for room in (1, 500, 1 << 20):
            got = []
            for run in kneser_ney.strips(given, room):
                found, at, starts = kneser_ney.tokens_of(run)
                distinct = found.cast(pa.binary()).to_pylist()
                assert len(set(distinct)) == len(distinct) == len(set(at.tolist()))
                assert kneser_ney.xxh64(found).tolist() == [xxhash.xxh64_intdigest(w) for w in distinct]
                got += [[distinct[k] for k in part] for part in np.split(at, starts[1:])]
            assert got == want


def test_scoring_calls_nothing_per_word(spark, docs):
    """Words are split, hashed and looked up as arrays: a hundred times the words, the same calls."""
    scorer = kneser_ney.Scorer(kneser_ney.train(docs, order=3))

    def calls(words: int) -> int:
        given = pa.array([" ".join(f"w{k}" for k in range(words)).encode()], pa.binary())
        seen = Counter()
        sys.setprofile(lambda frame, event, arg: seen.update([event]))
        try:
            for run in kneser_ney.strips(given):
                scorer.texts(run)
        finally:
            sys.setprofile(None)
        return seen["call"] + seen["c_call"]

    calls(100)  # what is read and imported once
    assert calls(20_000) < 1.5 * calls(200)


def test_counts_beyond_32_bits(tmp_path):
    folder = (tmp_path / "model").as_uri()
    counts = np.array([1, 254, 255, 256, 7, 2**32 + 5, 2**40, 0], np.int64)
    for given in (counts, counts[:2], counts[:0]):
        held = kneser_ney.Counts(folder, tuple(kneser_ney.Counts.write(folder, "c", given)))
        assert len(held) == len(given) and held.at(np.arange(len(given))).tolist() == given.tolist()
    assert kneser_ney.Counts(folder, None).at(np.empty(0, np.int64)).tolist() == []
    keys = np.arange(8, dtype=np.uint64)
    rows = [b for _ in range(2) for b in kneser_ney.shard_rows(keys, counts, np.empty(0, np.uint64))]
    ((shard, k, c),) = kneser_ney.merged(iter(rows))
    assert shard == 0 and k.tolist() == keys.tolist() and c.tolist() == (2 * counts).tolist()
