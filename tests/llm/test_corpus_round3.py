"""Operators 11 to 13 against numpy or a plain count, with edge cases."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tideline.llm import language_id, lexical_search, line_dedup, mixing, packing, simhash_dedup, vector_search, whitening
from tideline.llm.common import is_held_out

VECTORS = "vec_id long, embedding array<float>, label int, n long, whitened string, at string"
DOCS = "doc_id long, text string, source string, n long, size string, copies string, digest string, term string, place int"
ITEMS = "item_id long, text string, query int, rank string"


def table_of(spark, rows):
    return spark.createDataFrame([(i, v, 0, 1, "w", "a") for i, v in rows], VECTORS)


def documents(spark, rows):
    return spark.createDataFrame([(i, t, s, 1, "z", "c", "d", "t", 3) for i, t, s in rows], DOCS)


# operator 11 --------------------------------------------------------------------------------------

def matrices():
    rng = np.random.default_rng(3)
    q = np.linalg.qr(rng.normal(size=(30, 30)))[0]
    yield "plain", np.triu(rng.normal(size=(40, 40)))
    yield "one", np.array([[3.0]])
    yield "identity", np.eye(12)
    yield "split", np.diag([5.0, 5, 5, 1, 0, 0])
    yield "graded", np.diag(10.0 ** -np.arange(12)) @ np.triu(rng.normal(size=(12, 12)))
    yield "near multiple", np.diag(np.ones(41)) + np.diag(np.full(40, 1e-9), 1)
    yield "multiple", np.linalg.qr(q @ np.diag([9.0] * 5 + [4.0] * 5 + [1.0] * 20) @ q.T, mode="r")
    yield "rank 3", np.linalg.qr(rng.normal(size=(40, 3)) @ rng.normal(size=(3, 12)), mode="r")
    pairs = np.diag(np.abs(np.arange(-10, 11.0)) + 3) + np.diag(np.ones(20), 1) + np.diag(np.ones(20), -1)
    yield "pairs of close values", np.linalg.cholesky(pairs).T


@pytest.mark.parametrize("name,r", list(matrices()), ids=lambda x: x if isinstance(x, str) else "")
def test_the_solver_finds_orthonormal_singular_vectors(name, r):
    values, axes = whitening.components(r, 8)
    want = np.linalg.svd(r)[1] ** 2
    assert len(values) == min(8, int((want > want[0] * 1e-24).sum()))
    np.testing.assert_allclose(values, want[:len(values)], rtol=1e-10)
    np.testing.assert_allclose(axes.T @ axes, np.eye(len(values)), atol=1e-13)
    np.testing.assert_allclose(r.T @ (r @ axes), axes * values, atol=1e-13 * want[0])


def test_singular_values_of_a_graded_bidiagonal_are_accurate_relatively():
    a, b = 10.0 ** -np.arange(0, 24, 2), 10.0 ** -np.arange(1, 23, 2)
    got = whitening.singular_squares(a, b)
    assert math.isclose(np.prod(got), np.prod(a * a), rel_tol=1e-12)  # the determinant is the diagonal's


def test_whitening_matches_the_covariance_of_exact_numbers(spark):
    rng = np.random.default_rng(5)
    v = (rng.normal(size=(400, 10)) * np.arange(1, 11)).astype(np.float32)
    v[:130] = v[0]  # a third of the rows are one vector
    rows = [(i, x.tolist()) for i, x in enumerate(v)]
    odd = [(900, None), (901, [None] * 10), (902, [float("nan")] * 10), (903, [float("inf")] * 10), (904, [1.0]), (905, []), (906, [4e9] * 10)]
    again = [(None, rows[5][1]), (7, rows[7][1])]
    df = table_of(spark, rows + odd + again).repartition(7)
    wide = whitening.whiten(whitening.vectors(df)).collect()
    x = np.floor(np.array([r[1] for r in rows + again], dtype=np.float64) * 1024).astype(np.int64) + 100000
    n, y = len(x), len(x) * x - x.sum(axis=0)
    cov = (y / n).T @ (y / n) / n
    e, axes = np.linalg.eigh(cov)
    e, axes = e[::-1][:8], axes[:, ::-1][:, :8]
    assert len(wide) == n and {r["n"] for r in wide} == {n}
    assert sorted(r["deviation"] for r in wide) == sorted((y * y).sum(axis=1).tolist())
    got = np.array(sorted(((r["deviation"], *np.abs(r["whitened"])) for r in wide)))[:, 1:]
    want = np.abs((y / n) @ axes / np.sqrt(e))
    np.testing.assert_allclose(got, want[np.argsort((y * y).sum(axis=1), kind="stable")], atol=1e-9)
    np.testing.assert_allclose(wide[0]["explained"], e / np.trace(cov), rtol=1e-10)
    assert {r["identity_error"] for r in wide} == {wide[0]["identity_error"]} and wide[0]["identity_error"] < 1e-12


def test_triangles_merge_in_a_tree(spark):
    rng = np.random.default_rng(6)
    x = np.floor(rng.normal(size=(300, 4)) * 1000).astype(np.int64)
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id long, x array<long>").repartition(13)
    n, s = whitening.sums(df)
    r = whitening.triangle(df, n, s, fan=2)
    y = x - x.mean(axis=0)
    assert (n, s) == (300, x.sum(axis=0).tolist())
    np.testing.assert_allclose(r.T @ r, y.T @ y, rtol=1e-10, atol=1e-6)


def test_exact_squares_beyond_a_long():
    x = np.array([[1 << 33, 0], [0, 1]], dtype=np.int64)
    y = whitening.spread_out(x, 1 << 31, np.array([0, 0]))
    assert whitening.squares(y) == [None, 1 << 62]


@pytest.mark.parametrize("rows", [[], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])], [(1, None)], [(1, [])]])
def test_whitening_without_variance_is_empty(spark, rows):
    assert whitening.whiten(whitening.vectors(table_of(spark, rows))).collect() == []


# operator 12 --------------------------------------------------------------------------------------

def plain_targets(sizes, weights, share, cap):
    """Reshare by weight until none is above its cap."""
    total, capped = share * sum(sizes.values()), {}
    weight = {s: weights[i % len(weights)] for i, s in enumerate(sorted(sizes, key=lambda s: (s is None, s or "")))}
    while True:
        free = [s for s in sizes if s not in capped]
        level = (total - sum(capped.values())) / max(1, sum(weight[s] for s in free))
        above = [s for s in free if level * weight[s] > cap * sizes[s]]
        if not above:
            return {**capped, **{s: level * weight[s] for s in free}}
        capped |= {s: cap * sizes[s] for s in above}


def odd_documents():
    rng = random.Random(4)
    rows = [(None if i % 5 == 0 else i, " ".join("w" * rng.randint(1, 3) for _ in range(rng.randint(0, 60))), rng.choice(["a", "b", "ä", None]))
            for i in range(600)]
    rows += [(7, "equal row of words", "b")] * 300 + [(1000, None, "a"), (1001, "", "a"), (1002, "\t\n one\vtwo\f three\r\n", "a"),
                                                     (1003, "x " * 5000, "ä"), (1004, "", "empty source"), (1005, "one", "z")]
    return rows


def test_mixing_meets_its_targets(spark):
    rows = odd_documents()
    got = mixing.mix_counts(documents(spark, rows), slice_rows=16).collect()
    sizes, want = {}, Counter()
    for i, t, s in rows:
        n = len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
        sizes[s] = sizes.get(s, 0) + n
        want[(i, n, s)] += 1
    assert Counter((r["doc_id"], r["size"], r["source"]) for r in got) == want
    targets = plain_targets(sizes, mixing.WEIGHTS, 1.5, mixing.CAP)
    taken, longest = Counter(), Counter()
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and math.isclose(r["target"], targets[r["source"]], rel_tol=1e-12)
        assert r["taken"] == r["copies"] * r["size"] <= 2 * r["size"]
        assert abs(r["copies"] - r["target"] / max(1, r["source_size"])) < 1 or not r["source_size"]
        taken[r["source"]] += r["taken"]
        longest[r["source"]] = max(longest[r["source"]], r["size"])
    for s in sizes:
        assert abs(taken[s] - targets[s]) <= 1.1 * longest[s]


def test_mixing_agrees_on_any_partitioning(spark):
    df = documents(spark, odd_documents())
    runs = [Counter(map(tuple, mixing.mix_counts(df.repartition(p)).collect())) for p in (1, 9)]
    assert runs[0] == runs[1]


def test_the_mix_holds_each_text_as_often_as_planned(spark):
    df = documents(spark, odd_documents())
    plan = mixing.mix_plan(df).agg(F.sum("copies"), F.sum(F.col("copies") * F.col("size"))).first()
    mix = mixing.mixed_documents(df)
    assert mix.columns == ["doc_id", "source", "text"]
    assert tuple(mix.agg(F.count("*"), F.sum(mixing.word_count(F.col("text")))).first()) == tuple(plan)


def test_equal_rows_are_written_out_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(mixing, "CHUNK", 7)
    got = mixing.mix_counts(documents(spark, [(None, "same words here", "a")] * 100 + [(1, "other", "b")])).groupBy("doc_id", "copies").count().collect()
    assert sum(r["count"] for r in got if r["doc_id"] is None) == 100
    assert sum(r["count"] * r["copies"] for r in got if r["doc_id"] is None) in (149, 150, 151)


def test_mixing_runs_no_python_and_handles_an_empty_table(spark):
    assert mixing.mix_counts(documents(spark, [])).collect() == []
    assert [tuple(r)[1:6] for r in mixing.mix_counts(documents(spark, [(1, None, None)])).collect()] == [(0, 0, 0.0, 0, mixing.SEED * 0)]


def test_the_size_class_grows_with_the_size(spark):
    got = [r[0] for r in spark.range(70000).select(mixing.size_class(F.col("id")).alias("c"), "id").orderBy("id").select("c").collect()]
    assert got == sorted(got) and got[:64] == list(range(64))


# operator 13 --------------------------------------------------------------------------------------

def plain_ranking(docs, items, k):
    """Every document scored for every item."""
    def terms(t):
        return re.findall(r"[0-9a-z\x80-\U0010ffff]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))

    counts = [(i, Counter(terms(t))) for i, t, _ in docs]
    n_docs, length = sum(1 for _, c in counts if c), sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    out = []
    for item, text in items:
        scored = []
        for i, c in counts:
            m = 75 + 25 * sum(c.values()) * n_docs // max(1, length)
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t in terms(text) if t in c)
            scored.append((-s, i is None, i))
        out += [(item, r + 1, i, -s) for r, (s, _, i) in enumerate(sorted(x for x in scored if x[0] < 0)[:k])]
    return out


def corpus():
    rng = random.Random(8)
    words = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join(rng.choices(words, [1 / (j + 1) for j in range(400)], k=rng.randint(1, 80))), "s") for i in range(700)]
    rows += [(1000 + i, "copy of w3 W399 text", "s") for i in range(300)]
    return rows + [(None, "w3 w399 w7", "s"), (None, "w3 w399 w7", "s"), (5, "w5 w6 again", "s"), (2000, None, "s"), (2001, "", "s"), (2002, " .,;\t\n", "s"),
                   (2003, "w9 " * 4000, "s"), (2004, "Ä　x é-É W9", "s")]


def test_ranked_search_finds_exactly_the_best(spark):
    docs = corpus()
    items = [(1, "w1 w2 w3 w3 w3"), (2, "W399"), (3, "copy of text"), (4, "nothing known"), (5, ""), (6, None), (7, "é É Ä　x"), (None, "w5 w6"),
             (8, "w300 w301 w302 w0"), (8, "w9"), (1, "w1 w2 w3 w3 w3")]
    asked = spark.createDataFrame([(i, t, 0, "r") for i, t in items], ITEMS)
    df = documents(spark, docs).repartition(5)
    want = sorted(plain_ranking(docs, items[:-1], 20), key=repr)
    for how in ({}, {"first": 3, "query_block": 2}):
        got = lexical_search.search(df, lexical_search.build_index(df), asked, **how)
        assert sorted(map(tuple, got.collect()), key=repr) == want


def test_bounds_are_never_below_scores():
    rng = random.Random(9)
    for size in (1, 5, 60, 900):
        text = " ".join(f"w{rng.randint(0, size)}" for _ in range(2 * size)).encode() + b" w0" * 200
        counts = Counter(lexical_search.terms_of(text))
        terms = sorted({f"w{i}".encode() for i in range(0, 2 * size, 3)} | {b"w0", b"absent"})
        b = lexical_search.Batch(terms, np.arange(len(terms)), np.full(len(terms), 5), np.array([0]), 10, 1000)
        n = sum(counts.values())
        bound = b.bounds([lexical_search.fold(counts)], np.array([n]))[0, 0]
        exact = b.scores(text, np.array([0]))[0]
        assert exact <= bound <= 5 * 10**6 * len(terms)


def test_search_over_empty_tables(spark):
    none, some = documents(spark, []), documents(spark, corpus()[:3])
    items = spark.createDataFrame([(1, "w1", 0, "r")], ITEMS)
    assert lexical_search.search(none, lexical_search.build_index(none), items).collect() == []
    assert lexical_search.search(some, lexical_search.build_index(some), items.where("false")).collect() == []


def test_term_counts_are_handed_on_in_parts(spark, monkeypatch):
    monkeypatch.setattr(lexical_search, "DF_TERMS", 10)
    df = documents(spark, corpus()).repartition(3)
    index = lexical_search.build_index(df)
    got = index.frequencies(spark.createDataFrame([(b"w3",), (b"w399",), (b"no",)], "term binary")).collect()
    want = Counter(t for _, text, _ in corpus() for t in set(lexical_search.terms_of((text or "").encode())))
    assert {bytes(r["term"]): r["df"] for r in got} == {t: want[t] for t in (b"w3", b"w399")}


# operators 2 and 10 -------------------------------------------------------------------------------

def plain_removed(docs):
    """Lines equal or similar (0.8) to an earlier line."""
    lines = [(i, n, frozenset(re.findall(r"[^\x20\x09-\x0D]+", line))) for i, t, _ in docs for n, line in enumerate((t or "").split("\n"))]
    lines.sort(key=lambda x: x[:2])
    out: dict = {}
    for at, (i, n, words) in enumerate(lines):
        if words and any(y and 5 * len(words & y) >= 4 * len(words | y) for _, _, y in lines[:at]):
            out.setdefault(i, []).append(n)
    return out


def line_groups():
    """Groups of similar lines whose members are not all alike, and one word in every line."""
    rng = random.Random(12)
    docs = []
    bases = [[f"b{g}x{j}" for j in range(rng.randint(4, 90))] for g in range(6)]
    for i in range(120):
        lines = []
        for _ in range(rng.randint(1, 4)):
            own = list(rng.choice(bases))
            for _ in range(rng.randint(0, max(1, len(own) // 7))):
                own[rng.randrange(len(own))] = f"v{rng.randint(0, 400)}"
            lines.append(" ".join(["everywhere", *own]))
        docs.append((i, "\n".join(lines), "s"))
    return docs


def test_line_dedup_against_all_pairs(spark):
    docs = line_groups()
    got = line_dedup.line_decisions(documents(spark, docs)).collect()
    want = plain_removed(docs)
    assert {r["doc_id"]: [int(x) for x in r["removed"].split(",")] for r in got if r["n_removed"]} == want
    assert 50 < sum(map(len, want.values())) and any(r["n_removed"] < r["n_lines"] for r in got)


def test_cutting_lines_is_linear_in_a_text(spark):
    text = "\n".join(["the same line of text here"] * 60000 + ["another line", "", "the same line of text here"])
    got = line_dedup.dedup_lines(documents(spark, [(1, text, "s"), (2, None, "s"), (3, "a\n\nb", "s"), (4, "a", "s")])).collect()
    assert {r["doc_id"]: r["text"] for r in got} == {1: "the same line of text here\nanother line\n", 2: None, 3: "a\n\nb", 4: ""}


def test_scaled_copies_are_one_direction(spark):
    rng = np.random.default_rng(13)
    v = rng.normal(size=(2000, 16)).astype(np.float32).astype(np.float64)
    v[100:500] = v[100] * 2.0 ** rng.integers(-8, 9, 400)[:, None]
    rows = [(i, x.tolist(), "n") for i, x in enumerate(v)]
    df = vector_search.vector_rows(spark.createDataFrame(rows, "vec_id long, embedding array<double>, node string"))
    index = vector_search.build_index(df, 5, shard_rows=512)
    assert index.count() == 1601
    queries = df.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "v")
    got: dict = {}
    for r in vector_search.search(index, queries, 5).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    u, hit = v / np.linalg.norm(v, axis=1, keepdims=True), 0
    for q, found in got.items():
        s = np.round(u @ u[q], 9)
        hit += len(set(found) & set(sorted((i for i in range(2000) if i != q), key=lambda i: (-s[i], i))[:5]))
    assert len(got) == 40 and hit >= 0.95 * 200
    assert sorted(got[150]) == [100, 101, 102, 103, 104]


# operator 4 ---------------------------------------------------------------------------------------

def test_packing_of_one_key_with_very_many_equal_pieces(spark):
    df = spark.range(300000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("three equal words").alias("text"), F.col("id").alias("piece"))
    df = df.unionAll(spark.range(50).select("id", F.concat_ws(" ", F.array_repeat(F.lit("w"), (F.col("id") % 7 + 1).cast("int"))), "id"))
    out = packing.pack(df, buckets=2, budget=30, slice_rows=100)
    per = out.groupBy("bucket", "slice", "batch").count().agg(F.max(F.col("count") * F.col("bucket")), F.sum("count")).first()
    assert per[0] <= 30 and per[1] == 300050
    whole = out.filter("n_words = 3").groupBy("slice").agg(F.count("*").alias("n"), F.count_distinct("batch").alias("b")).collect()
    assert sum(r["n"] for r in whole) >= 300000


# pieces of operators 3, 5, 6 and 9 against plain versions -----------------------------------------

def test_components_of_a_hub_and_a_chain(spark):
    from tideline.llm.components import connected_components

    links = [(1, i) for i in range(2, 400)] + [(1000 + i, 1001 + i) for i in range(60)] + [(-5, 1000), (7, 7)]
    got = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(2, 400), 1), **dict.fromkeys(range(1000, 1061), -5)}


def test_fingerprints_against_a_plain_count(spark):
    import xxhash

    texts = [None, "", "one", "one two", "A b C d e", "a b c d e a b c d e", "é Ü ß É x", "w " * 70000 + "end", " \t x\ny\r z "]
    df = documents(spark, [(i, t, "s") for i, t in enumerate(texts)])
    got = {r["doc_id"]: r["fingerprint"] for r in simhash_dedup.simhash_components(df, simhash_dedup.SHINGLE, simhash_dedup.RADIUS).collect()}
    for i, t in enumerate(texts):
        words = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
        shingles = [" ".join(words[j:j + 3]) for j in range(len(words) - 2)] or ([" ".join(words)] if words else [])
        counts = Counter(xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles)
        bits = sum(1 << b for b in range(64) if 2 * sum(c for h, c in counts.items() if h >> b & 1) > len(shingles))
        assert got[i] == f"{bits:016x}", i


def test_operators_take_empty_tables(spark):
    none = documents(spark, []).withColumn("lang", F.lit("en"))
    assert language_id.predict(none, language_id.learn(none)).collect() == []
    assert simhash_dedup.simhash_components(none, simhash_dedup.SHINGLE, simhash_dedup.RADIUS).collect() == []
    assert packing.pack(none).collect() == []


def test_every_language_is_learned(spark):
    rows = [(i, f"{chr(97 + i % 26)}{chr(97 + i // 26)} " * 9, f"l{i:04d}") for i in range(520)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    held = {r["lang"] for r in df.filter(~is_held_out(F.col("doc_id"))).collect()}
    net = language_id.learn(df)
    assert set(net.langs) == held and len(held) > 400
