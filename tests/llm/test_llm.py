"""Corpus operators against brute force, the library or held-out labels, with edge cases."""

from __future__ import annotations

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tideline.llm import (language_id, line_dedup, packing, quality_classifier, quality_rules, sentencepiece_codec,
                          simhash_dedup, stats, suffix_dedup, url_filters, vector_search)
from tideline.llm.common import is_held_out

SMOKE_DIR = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, n_chars long, words string, line int, doc string"


def documents(spark, rows):
    """Documents with extra columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, t, len(t or ""), "w", 1, "d") for i, t in rows], DOCS)


def odd_texts():
    rng = random.Random(2)
    long = " ".join(rng.choice("abcdefgh") * rng.randint(1, 9) for _ in range(6000))
    shared = "".join(rng.choice("qwertz uiop") for _ in range(180))
    return [(0, None), (1, ""), (2, " \t\n "), (3, "word"), (4, "one two three four five\nÄÖ ü\u3000x\none two three four five"),
            (5, long), (6, long), (7, "x" * 400), (8, "start " + shared + " end"), (9, shared), (9, shared), (9, "other " + shared),
            (None, shared + " null id"), (11, "é" * 150), (12, long[:500] + "\n" + shared)]


# operator 1 ---------------------------------------------------------------------------------------

def model_file():
    public_tokenizers = pytest.importorskip("public_tokenizers")
    return public_tokenizers.path(sentencepiece_codec.MODEL)


def test_encoding_matches_the_library_and_spans_cover_the_text(spark):
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=model_file())
    texts = {i: t for i, (_, t) in enumerate(odd_texts())}
    got = sentencepiece_codec.encode_documents(documents(spark, texts.items()), model_file()).collect()
    assert len(got) == len(texts)
    for r in got:
        text = texts[r["doc_id"]] or ""
        proto = lib.encode(text, return_type="proto")
        assert r["ids"] == lib.encode(text)
        assert [(b, e) for b, e in zip(r["begins"], r["ends"], strict=True)] == [(p.begin, p.end) for p in proto.pieces]


def test_normaliser_by_longest_prefix_matches_the_library():
    import sentencepiece

    lib = sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc")
    ours = sentencepiece_codec.Normalizer.of_model(lib.serialized_model_proto())
    for text in ("ｆｕｌｌ　ｗｉｄｔｈ ①②", "  two  spaces ", "ﬁne e\u0301 がぎ", "plain", "", "   ", "tab\there"):
        normal, source = ours.normalize(text)
        shown, offsets = lib.normalize(text, with_offsets=True)
        assert normal.decode() == shown
        chars = [0, *np.cumsum([len(c.encode()) for c in text]).tolist()]
        starts = [0, *np.cumsum([len(c.encode()) for c in shown]).tolist()]
        assert [int(source[s]) for s in starts] == [chars[o] for o in offsets]


def test_decoding_and_digests(spark):
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=model_file())
    df = documents(spark, [(0, None), (1, "some text é"), (2, "")])
    ids = sentencepiece_codec.encode_documents(df, model_file())
    back = {r[0]: r[1] for r in ids.select("doc_id", sentencepiece_codec.decoded(F.col("ids"), model_file())).collect()}
    assert back == {0: "", 1: "some text é", 2: ""}
    r = {x["doc_id"]: x for x in sentencepiece_codec.digest_documents(df, model_file()).collect()}
    assert r[1]["ids_sha256"] == hashlib.sha256(",".join(map(str, lib.encode("some text é"))).encode()).hexdigest()
    assert r[0]["n_tokens"] == 0 and r[1]["source_bytes"] == len("some text é".encode())


# operator 2 ---------------------------------------------------------------------------------------

def brute_lines(rows):
    sets = []
    for i, t in sorted(rows):
        for k, line in enumerate((t or "").split("\n")):
            w = frozenset(line.encode().split())
            if w and t is not None:
                sets.append((i, k, w))
    return {(i, k) for n, (i, k, w) in enumerate(sets)
            if any(5 * len(w & v) >= 4 * len(w | v) for _, _, v in sets[:n])}


def test_line_dedup_matches_brute_force(spark):
    rng = random.Random(4)
    vocab = [f"w{i}" for i in range(60)]
    base = [[rng.choice(vocab) for _ in range(rng.randint(1, 200 if i < 2 else 14))] for i in range(25)]
    rows = []
    for i in range(40):
        lines = []
        for _ in range(rng.randint(0, 5)):
            w = list(rng.choice(base))
            for _ in range(rng.randint(0, 2)):
                w[rng.randrange(len(w))] = rng.choice(vocab)
            lines.append(rng.choice([" ", "  ", "\t"]).join(w))
        rows.append((i, "\n".join(lines)))
    rows += [(90, None), (91, ""), (92, "\n \n")]
    got = line_dedup.line_decisions(documents(spark, rows)).collect()
    assert len(got) == len(rows)
    assert {(r["doc_id"], int(k)) for r in got for k in r["removed"].split(",") if k} == brute_lines(rows)
    assert {r["doc_id"]: r["n_lines"] for r in got}[92] == 3


def test_line_dedup_odd_rows_and_empty_table(spark):
    df = documents(spark, odd_texts())
    out = line_dedup.dedup_lines(df)
    assert out.columns == df.columns and out.count() == df.count()
    kept = [r["text"] for r in out.collect() if r["doc_id"] == 4]
    assert kept == ["one two three four five\nÄÖ ü\u3000x"]
    same = [r["text"] for r in out.collect() if r["doc_id"] == 9]
    assert len(set(same)) <= 2  # repeated rows get one result
    assert line_dedup.line_decisions(df.limit(0)).collect() == []


# operator 3 ---------------------------------------------------------------------------------------

def test_language_id_held_out_accuracy_and_unknown(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    net = language_id.learn(docs, per_lang=300)
    got = language_id.predict(docs, net).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(got) > 100
    assert sum(r["lang_pred"] == r["lang"] for r in got) >= 0.95 * len(got)
    odd = language_id.predict(documents(spark, [(0, None), (1, ""), (2, "12 34!"), (None, "a" * 100_000)]), net).collect()
    assert [r["lang_pred"] for r in odd[:3]] == ["und"] * 3 and odd[3]["lang_pred"] in net.langs
    assert all(0 <= r["score"] <= 1 for r in odd)
    nothing = language_id.learn(docs.limit(0))
    assert language_id.predict(docs.limit(2), nothing).first()["lang_pred"] == "und"


# operator 4 ---------------------------------------------------------------------------------------

def test_boundaries_are_optimal():
    from itertools import combinations

    rng = random.Random(1)
    for _ in range(30):
        lengths = sorted(rng.sample(range(1, 40), rng.randint(1, 8)))
        counts = [rng.randint(1, 9) for _ in lengths]
        k = rng.randint(1, 4)

        def padding(bounds):
            return sum(c * (min(b for b in bounds if b >= n) - n) for n, c in zip(lengths, counts, strict=True))

        best = min(padding((*c, lengths[-1])) for r in range(k) for c in combinations(lengths[:-1], r))
        bounds = packing.best_boundaries(lengths, counts, k)
        assert padding(bounds) == best and len(bounds) <= k


def test_packing_keeps_every_word_once(spark):
    df = documents(spark, odd_texts())
    out = packing.pack(df, max_len=50, buckets=4, budget=120, slice_rows=20).collect()
    assert sum(r["n_words"] for r in out) == sum(len((t or "").encode().split()) for _, t in odd_texts())
    batches: dict = {}
    for r in out:
        assert r["padding"] == r["bucket"] - r["n_words"] >= 0
        batches[r["bucket"], r["slice"], r["batch"]] = batches.get((r["bucket"], r["slice"], r["batch"]), 0) + 1
    assert all(n <= max(1, 120 // b) for (b, _, _), n in batches.items())
    assert packing.pack(df.limit(0)).collect() == []


def test_packing_ranks_counted_rows(spark):
    rows = [(None if i % 3 == 0 else i, "w " * (1 + i % 4)) for i in range(600)]
    out = packing.pack(documents(spark, rows), buckets=2, budget=12, slice_rows=50)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate explode") < plan.index("Window [") < plan.index("Aggregate [")
    got = [(r["bucket"], r["slice"], r["doc_id"] is not None, r["doc_id"] or 0, r["piece"], r["n_words"], r["batch"]) for r in out.collect()]
    assert len(got) == 600
    groups: dict = {}
    for r in sorted(got):
        place = groups[r[:2]] = groups.get(r[:2], -1) + 1
        assert r[6] == place // max(1, 12 // r[0])


# operators 5 and 9 --------------------------------------------------------------------------------

def test_repeated_words_matches_brute_force():
    rng = random.Random(3)
    for _ in range(40):
        words = [rng.choice([b"a", b"b"]) for _ in range(rng.randint(0, 40))]
        grams = [tuple(words[i:i + 8]) for i in range(len(words) - 7)]
        want = {j for i, g in enumerate(grams) if grams.count(g) > 1 for j in range(i, i + 8)}
        assert stats.repeated_words(words) == len(want)


def test_quality_rules(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    rules = quality_rules.fit(docs, labels, fit_rows=500, max_labels=500)
    got = quality_rules.judge(docs, rules).join(labels, "doc_id").collect()
    good = [r for r in got if r["quality"] == 1 and not r["base_failed"]]
    assert sum(r["kept"] for r in good) >= 0.97 * len(good)
    odd = quality_rules.judge(documents(spark, odd_texts()), rules).collect()
    assert len(odd) == len(odd_texts()) and all(r["base_failed"] and not r["kept"] for r in odd if r["n_words"] < 20)
    x = odd[4]
    assert (x["n_words"], x["n_dup_lines"], x["word_chars"]) == (12, 1, 19 * 2 + 5)
    none = quality_rules.fit(docs.limit(0), labels)
    assert none.forest is None and quality_rules.judge(docs.limit(3), none).count() == 3


def test_quality_rules_remove_held_out_bad_texts(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    held = is_held_out(F.col("doc_id"))
    got = quality_rules.judge(docs, quality_rules.fit(docs, labels.where(~held))).join(labels.where(held), "doc_id").collect()
    bad, good = ([r["kept"] for r in got if r["quality"] == q and not r["base_failed"]] for q in (0, 1))
    assert len(bad) >= 30 and sum(bad) <= 0.05 * len(bad)
    assert sum(good) >= 0.98 * len(good)


def test_calibration_looks_at_both_classes():
    good, bad = np.linspace(0.3, 0.5, 1000), np.linspace(0.495, 0.6, 50)
    score, is_good = np.concatenate([good, bad]), np.arange(1050) < 1000
    cut = quality_rules.calibrate(score, is_good, max_loss=0.01)
    assert (good > cut).mean() <= 0.01 and (bad > cut).mean() >= 0.9
    assert quality_rules.calibrate(np.concatenate([good, bad + 0.1]), is_good) >= 0.5  # no good text is lost for nothing
    assert quality_rules.calibrate(np.concatenate([good, bad - 0.4]), is_good) == 1.0


def test_quality_rules_fit_on_all_rows(spark, monkeypatch):
    rng = np.random.default_rng(8)
    n = 12000
    x = rng.normal(0.5, 0.05, (n, len(quality_rules.FOREST_FEATURES)))
    x[:, 0] = np.where(np.arange(n) % 10 == 0, 0.9, x[:, 0])
    rows = [(i, i, 100, 0, *map(float, r)) for i, r in enumerate(x)]
    columns = "doc_id long, row_hash long, n_words long, n_repeat_words long, " + ", ".join(
        f"{f} double" for f in quality_rules.FOREST_FEATURES)
    df = spark.createDataFrame(rows, columns)
    samples = quality_rules.tree_samples(df)
    assert {s.shape for s in samples} == {(256, x.shape[1])}
    assert len({r.tobytes() for s in samples for r in s}) > 0.95 * n  # the trees see the whole corpus, not one pool
    seen = []
    monkeypatch.setattr(quality_rules, "calibrate", lambda score, good, count: seen.append(count.sum()) or 1.0)
    quality_rules.fit_stats(df, spark.createDataFrame([(i, int(i % 10 > 0)) for i in range(n)], "doc_id long, quality int"))
    assert seen == [n]
    twins = spark.createDataFrame([(None, 7, *rows[0][2:])] * 600 + rows[:600], columns)
    assert max(len(s) for s in quality_rules.tree_samples(twins)) == 256


def test_quality_classifier_on_held_out_labels(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    model = quality_classifier.learn(docs, labels)
    got = quality_classifier.score_documents(docs, model).join(labels, "doc_id").where("held_out").collect()
    assert sum(r["predicted"] == r["quality"] for r in got) >= 0.95 * len(got)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got)
    odd = documents(spark, odd_texts())
    assert quality_classifier.score_documents(odd, model).count() == len(odd_texts())
    assert quality_classifier.accepted(odd, model).columns == odd.columns
    assert quality_classifier.learn(docs, labels.limit(0)).rules == []


# operator 6 ---------------------------------------------------------------------------------------

def test_covering_masks_let_every_near_pair_collide():
    rng = random.Random(5)
    for radius in (1, 2, 3):
        masks = simhash_dedup.covering_masks(radius)
        for _ in range(300):
            diff = sum(1 << b for b in rng.sample(range(64), radius))
            assert any(not diff & m for m in masks)


@pytest.mark.parametrize("radius", [1, 2, 3])
def test_links_match_all_pairs(spark, radius):
    rng = np.random.default_rng(radius)
    base = rng.integers(0, 1 << 63, 6, dtype=np.uint64)
    prints = {int(p) ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 4), replace=False)) for p in base for _ in range(12)}
    signed = {p - (1 << 64) if p >> 63 else p for p in prints}
    links = simhash_dedup.fingerprint_links(spark.createDataFrame([(p,) for p in signed], "fp long"), radius).collect()
    parent = {p: p for p in signed}

    def find(p):
        while parent[p] != p:
            p = parent[p]
        return p

    for r in links:
        parent[find(r["a"])] = find(r["b"])
    want = {p: p for p in signed}

    def find2(p):
        while want[p] != p:
            p = want[p]
        return p

    mask = (1 << 64) - 1
    for a in signed:
        for b in signed:
            if ((a ^ b) & mask).bit_count() <= radius:
                want[find2(a)] = find2(b)
    groups = {frozenset(q for q in signed if find(q) == find(p)) for p in signed}
    assert groups == {frozenset(q for q in signed if find2(q) == find2(p)) for p in signed}


def test_simhash_documents(spark):
    df = documents(spark, odd_texts())
    got = simhash_dedup.simhash_components(df).collect()
    assert len(got) == len(odd_texts())
    by = {r["doc_id"]: r for r in got}
    assert by[0]["fingerprint"] == by[1]["fingerprint"] == by[2]["fingerprint"] == "0" * 16
    assert {by[i]["component_id"] for i in (0, 1, 2)} == {0} and by[6]["component_id"] == 5
    kept = simhash_dedup.one_per_group(df)
    assert kept.columns == df.columns and {0, 5} <= {r["doc_id"] for r in kept.collect()}
    assert simhash_dedup.simhash_components(df.limit(0)).collect() == []


def test_one_per_group_decides_per_row(spark):
    rng = random.Random(9)
    a, b, c = (" ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(80)) for _ in range(3))
    rows = [(1, a), (2, a), (2, b), (None, a), (None, c), (None, c), (3, c.upper()), (4, None), (None, None), (5, "x y z"), (5, "x y z")]
    kept = [(r["doc_id"], r["text"]) for r in simhash_dedup.one_per_group(documents(spark, rows)).collect()]
    assert sorted(kept, key=str) == sorted([(1, a), (2, b), (3, c.upper()), (4, None), (5, "x y z")], key=str)
    assert [r["text"] for r in simhash_dedup.one_per_group(documents(spark, [(None, c)] * 5)).collect()] == [c]


# operator 7 ---------------------------------------------------------------------------------------

@pytest.mark.parametrize("split", [4000, 1])
def test_suffix_dedup_matches_brute_force(spark, monkeypatch, split):
    monkeypatch.setattr(suffix_dedup, "SPLIT_KINDS", split)
    rng = random.Random(6)
    parts = ["".join(rng.choice("ab é") for _ in range(rng.randint(40, 260))) for _ in range(8)]
    rows = [(i, "".join(rng.choice(parts) + rng.choice(["", "x", "yz"]) for _ in range(rng.randint(0, 6)))) for i in range(30)]
    rows += [(40, None), (41, ""), (42, "z" * 350), (43, "z" * 99)]
    got = {r["doc_id"]: r for r in suffix_dedup.dedup_documents(documents(spark, rows)).collect()}
    seen = set()
    for i, text in sorted(rows):
        data = (text or "").encode()
        gone = np.zeros(len(data), dtype=bool)
        for s in range(len(data) - 99):
            if data[s:s + 100] in seen:
                gone[s:s + 100] = True
            seen.add(data[s:s + 100])
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        kept = bytes(np.frombuffer(data, dtype=np.uint8)[~gone])
        assert tuple(got[i])[1:] == (len(data), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()), i


def test_suffix_dedup_odd_rows(spark):
    df = documents(spark, odd_texts())
    out = suffix_dedup.dedup_texts(df)
    assert out.columns == df.columns and out.count() == df.count()
    by = {}
    for r in suffix_dedup.dedup_documents(df).collect():
        by.setdefault(r["doc_id"], []).append(r["n_removed"])
    assert by[6] == [len(odd_texts()[5][1])] and by[0] == [0]
    assert len(by[9]) == 3 and all(n >= 180 for n in by[9])  # repeats of the null id's text, which comes first
    assert suffix_dedup.dedup_documents(df.limit(0)).collect() == []


def test_deep_shallow_orders_suffixes():
    rng = np.random.default_rng(0)
    data = rng.integers(97, 99, 4000).astype(np.uint8)
    data[1000:1400] = data[2000:2400]
    starts = np.arange(3800)
    order, group = suffix_dedup.deep_shallow(data, starts)
    raw = data.tobytes()
    keys = [raw[s:s + 100] for s in starts[order].tolist()]
    assert keys == sorted(keys)
    assert [a == b for a, b in zip(keys, keys[1:], strict=False)] == (group[1:] == group[:-1]).tolist()


# operator 8 ---------------------------------------------------------------------------------------

def test_url_filters(spark):
    urls = [(0, None), (1, "no scheme"), (2, "http://A.Example.ORG/es/x?q"), (3, "http://example.org/en/12"), (4, "http://org/"),
            (5, "http://org"), (6, "http://x.com/fr/"), (7, "http://x.com/fr"), (8, "http://notexample.org/es/"), (9, "a://b://c/"),
            (10, "http:///x"), (2, "http://A.Example.ORG/es/x?q"), (None, "http://y.com/de/#f")]
    df = spark.createDataFrame([(i, u, "r", "k") for i, u in urls], "page_id long, url string, rule string, keys string")
    got = [tuple(r) for r in url_filters.judge_urls(df).collect()]
    assert got == [
        (0, "", "", None, "allow"), (1, "", "", None, "allow"), (2, "a.example.org", "/es/x", "example.org/es/", "block"),
        (3, "example.org", "/en/12", "example.org/en/1", "block"), (4, "org", "/", "org/", "allow"), (5, "org", "", None, "allow"),
        (6, "x.com", "/fr/", "com/fr/", "allow"), (7, "x.com", "/fr", None, "allow"), (8, "notexample.org", "/es/", "org/", "allow"),
        (9, "b:", "//c/", None, "allow"), (10, "", "/x", None, "allow"), (2, "a.example.org", "/es/x", "example.org/es/", "block"),
        (None, "y.com", "/de/", "com/de/", "block")]
    assert url_filters.judge_urls(df.limit(0)).collect() == []


def test_cascade_is_exact_over_its_universe(spark):
    listed = [f"k{i}" for i in range(0, 3000, 7)]
    universe = spark.range(3000).select(F.concat(F.lit("k"), F.col("id").cast("string")).alias("key"))
    cascade = url_filters.build_cascade(listed, universe, 900)  # undersized on purpose: several levels
    assert len(cascade.levels) > 1
    keys = [f"k{i}" for i in range(3000)]
    assert {k for k, ok in zip(keys, cascade.has(*url_filters._hashes(keys, spark)), strict=True) if ok} == set(listed)


# operator 10 --------------------------------------------------------------------------------------

def test_vector_search_recall_and_odd_vectors(spark):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(900, 24))
    v[300:600] = v[300]  # a third of the rows share a vector
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(2000, None), (2050, [0.0] * 24), (2100, [float("nan")] * 24),
                                                         (2150, [1.0] * 3), (None, v[0].tolist())]
    df = vector_search.vector_rows(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    assert df.count() == 900
    queries = df.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "v")
    got: dict = {}
    for r in vector_search.search(vector_search.build_index(df, 5, shard_rows=300), queries, 5, query_block=7).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    u, hit = v / np.linalg.norm(v, axis=1, keepdims=True), 0
    for q in range(0, 900, 50):
        s = u @ u[q]
        best = sorted((i for i in range(900) if i != q), key=lambda i: (-round(s[i], 12), i))[:5]
        hit += len(set(best) & {i for i, _ in got[q]})
        assert len(got[q]) == 5 and all(math.isclose(x, s[i], abs_tol=1e-12) for i, x in got[q])
    assert hit >= 0.9 * 5 * 18
    assert [i for i, _ in got[300]] == [301, 302, 303, 304, 305]
    empty = vector_search.vector_rows(spark.createDataFrame([], "vec_id long, embedding array<double>"))
    assert vector_search.search(vector_search.build_index(empty, 5), queries.limit(0), 5).collect() == []


# pipeline -----------------------------------------------------------------------------------------

def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SMOKE_DIR}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, stage(spark, docs, SMOKE_DIR)
        assert docs.columns == before.columns, name
        docs = corpus_pipeline.save(docs, "test")
        assert 0 < docs.count() <= before.count()
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SMOKE_DIR)
    words = sum(len((r["text"] or "").encode().split()) for r in docs.collect())
    assert packed.agg(F.sum("n_words")).first()[0] == words


def test_pipeline_stages_take_empty_tables(spark):
    docs = spark.read.parquet(f"{SMOKE_DIR}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SMOKE_DIR).count() == 0
