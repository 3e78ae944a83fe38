"""What a query's contract fixes, compared word by word with the code and its SQL."""

import random

import duckdb

from pyspark.sql import functions as F

from tideline.llm import catalog, line_dedup, url_filters

RULES = {"org/": "allow", "example.org/es/": "block", "example.org/en/1": "block", "com/fr/": "allow", "com/de/": "block"}


def test_every_rule_has_the_contracts_verdict(spark):
    assert {**dict.fromkeys(url_filters.ALLOW, "allow"), **dict.fromkeys(url_filters.BLOCK, "block")} == RULES
    urls = [(i, f"http://sub.{rule}x") for i, rule in enumerate(RULES)]
    df = spark.createDataFrame(urls, "page_id long, url string")
    assert {r["rule"]: r["verdict"] for r in url_filters.judge_urls(df).collect()} == RULES
    con = duckdb.connect()
    con.execute("create table pages (page_id bigint, url varchar)")
    con.executemany("insert into pages values (?, ?)", urls)
    assert dict(con.execute(f"select rule, verdict from ({catalog.ORACLE_SQL['op8_url_filters']})").fetchall()) == RULES


def test_texts_of_lines_in_no_pair_are_held_back(spark):
    # op2: true for every place that is listed, for hardly any other, whatever the number listed
    lines = spark.range(60000).select(F.col("id").alias("doc"), F.lit(0).cast("long").alias("version"), F.lit(3).alias("line"))
    for step in (2, 500):
        places = lines.where(F.col("doc") % step == 0)
        known = lines.where(line_dedup._maybe_among(places, places.count()))
        n = places.count()
        assert known.join(places, ["doc", "version", "line"]).count() == n
        assert known.count() - n < 6000
    assert lines.where(line_dedup._maybe_among(lines.limit(0), 0)).count() == 0


def plain_gone(rows):
    sets = [((i, n), frozenset(line.split())) for i, t in sorted(rows) for n, line in enumerate(t.split("\n"))]
    return {at for k, (at, x) in enumerate(sets) if x and any(5 * len(x & y) >= 4 * len(x | y) for _, y in sets[:k])}


def test_lines_of_all_sizes_at_the_bound_of_similarity(spark):
    # op2: the smaller set meets the larger with a shorter prefix, in the larger one's size class, whichever is the later
    rng, rows, i = random.Random(5), [], 0
    for size in [*range(3, 46), 63, 64, 65, 95, 96, 97, 120, 191, 193, 250, 410]:
        base = [f"s{size}x{j}" for j in range(size)]
        for other in (base[: -(-4 * size // 5)], base[: max(1, -(-4 * size // 5) - 1)], base[: size - size // 9] + [f"o{size}x{j}" for j in range(size // 9)]):
            pair = [[f"{w}v{i}" for w in base], [f"{w}v{i}" for w in other]]
            rng.shuffle(pair)
            for words in pair:
                rng.shuffle(words)
                rows.append((i, " ".join(words)))
                i += 1
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = plain_gone(rows)
    got = line_dedup.line_decisions(df).where("n_removed > 0").collect()
    assert {(r["doc_id"], int(k)) for r in got for k in r["removed"].split(",")} == want
    assert 60 < len(want) < len(rows) // 2


def test_keys_of_words_are_plain_longs(spark):
    # op2: nothing in the arrays can be null, else Spark boxes every word to sort them
    df = spark.createDataFrame([(1, " b a  b\tc "), (2, ""), (3, None)], "doc_id long, text string")
    keys = df.select("doc_id", line_dedup.word_keys(F.col("text"), line_dedup.rarity_classes(df)).alias("keys"))
    assert not keys.schema["keys"].dataType.containsNull
    got = {r["doc_id"]: r["keys"] for r in keys.collect()}
    assert len(got[1]) == 3 and got[1] == sorted(got[1]) and got[2] == [] and not got[3]


def test_sets_of_close_sizes_meet_once_at_a_word_they_all_have(spark):
    # op2: over all size classes, every pair that the sizes allow, no other and none twice
    rows = [(n, [7, *range(1000 * n, 1000 * n + n // 5)], n) for n in range(4, 304)]
    df = spark.createDataFrame(rows, "doc long, prefix array<long>, n int")
    df = df.selectExpr("doc", "0L as version", "0 as line", "n", "0L as bits", "0L as half", "0L as low", "0L as high", "false as lost", "prefix")
    pairs = [line_dedup._meet(df, part).count() for part in range(line_dedup.PARTS)]
    close = sum(4 * x <= 5 * y for x in range(4, 304) for y in range(4, x) if 5 * y >= 4 * x)
    assert sum(pairs) == close


def test_only_crowded_words_lead(spark):
    # op2: the first step pairs a crowd with its first line only, and leaves words that few sets share to the second
    def rows(word, docs):
        return [(doc, [word, 1000 + doc], 20) for doc in docs]

    crowd, few = range(10, 10 + 2 * line_dedup.CROWD), range(500, 500 + line_dedup.CROWD)
    df = spark.createDataFrame(rows(7, crowd) + rows(8, few), "doc long, prefix array<long>, n int")
    df = df.selectExpr("doc", "0L as version", "0 as line", "n", "0L as bits", "0L as half", "0L as low", "0L as high", "prefix")
    got = sorted((r["x_doc"], r["y_doc"]) for r in line_dedup._with_leads(df).collect())
    assert got == [(doc, 10) for doc in crowd[1:]]


def test_crowds_of_similar_lines_of_all_sizes(spark):
    # op2: crowds whose sizes lie in several classes, with lines similar to their first line and lines similar to a later one only
    rng, rows = random.Random(6), []
    for crowd, size in enumerate((6, 11, 17, 25, 60, 130)):
        base = [f"c{crowd}w{j}" for j in range(size)]
        for _ in range(line_dedup.CROWD + 22):
            words = [w for w in base if rng.random() > 0.1] + [f"r{rng.randrange(10**6)}" for _ in range(rng.randrange(1 + size // 8))]
            rng.shuffle(words)
            rows.append((rng.randrange(10**9), " ".join(words)))
    want = plain_gone(rows)
    got = line_dedup.line_decisions(spark.createDataFrame(rows, "doc_id long, text string")).where("n_removed > 0").collect()
    assert {(r["doc_id"], int(k)) for r in got for k in r["removed"].split(",")} == want
    assert 100 < len(want) < len(rows) - 20


def test_least_size_of_a_class(spark):
    # op2: a higher class is met with a shorter prefix, which must allow for the least size there
    df = spark.range(1, 20000).select(F.col("id").alias("n")).select("n", line_dedup._size_class(F.col("n")).alias("c"))
    df = df.groupBy("c").agg(F.min("n").alias("n")).select("n", line_dedup._least_of_class(F.col("c")).alias("least"))
    assert all(r["n"] - 1 <= r["least"] <= r["n"] for r in df.collect())
