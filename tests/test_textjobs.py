from conftest import rows
from tideline.operators import textjobs
from tideline.operators.textjobs import (
    PLOT_TERMS,
    audit_references,
    classify_intent,
    conversation_log,
    extract_block,
    extract_formulas,
    parse_status,
    screen_terms,
)
from tideline.plans.steps import screen_request


def test_screen_terms(spark):
    # C18
    df = spark.createDataFrame([(1, "Please Filter Subjects over 60"), (2, "  "), (3, None)],
                               "id int, text string")
    got = rows(screen_terms(df, "text"), "id", "issues", "valid")
    assert got == [(1, ["filter subjects"], False), (2, [], True), (3, [], True)]


def test_screen_request_driver_helper_agrees(spark):
    text = "Make the plot title bigger and the Legend Font red"
    df = spark.createDataFrame([(text,)], "text string")
    assert screen_terms(df, "text", PLOT_TERMS).first()["issues"] == screen_request(text)


def test_classify_intent(spark):
    # C19
    texts = ["removing EOS", "add EOS", "remove the plot title", "hello", "take off EOS",
             "Took off the markers", None]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = [r["intent"] for r in classify_intent(df, "text").orderBy("id").collect()]
    assert got == ["remove", "add", "both", "none", "none", "remove", "none"]


def test_classify_intent_category_gate(spark):
    df = spark.createDataFrame([("remove EOS", "add_overlay"), ("add EOS", "remove_overlay"),
                                ("add EOS", "add_overlay")], "text string, category string")
    got = [r["wrong_category"] for r in classify_intent(df, "text", "category").collect()]
    assert got == ["Use the Remove Overlay category to remove a trace.",
                   "Use the Add Overlay category to add a new overlay.", None]


def test_parse_status(spark):
    # C20
    texts = ["\n# ALREADY_OVERLAID\n# EOS\n", "clarification_needed: which?",
             "fig = go.Figure()", "PROTECTED_TRACE: HBAR", None]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = [(r["status"], r["detail"]) for r in parse_status(df, "text").orderBy("id").collect()]
    assert got == [("already_overlaid", "EOS"), ("clarification_needed", "which?"),
                   (None, None), ("protected_trace", "HBAR"), (None, None)]


def test_extract_block(spark):
    # C21
    texts = ["Here:\n```python\nx = 1\n```\nbye", "```\ny = 2\n```", "```python\nz = 3",
             "no code", "```python``` and ```\nw = 4\n```"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = [r["block"] for r in extract_block(df, "text").orderBy("id").collect()]
    assert got == ["x = 1", "y = 2", "```python\nz = 3", "no code", "```python``` and ```\nw = 4\n```"]


def test_audit_references(spark):
    # C22
    df = spark.createDataFrame([(1, """df["AGE"] + x['zz'] + fig['markers'] + d["a"] + e["two words"]""")],
                               "id int, text string")
    catalog = spark.createDataFrame([("AGE",)], "name string")
    assert rows(audit_references(df, ["id"], "text", catalog)) == [(1, "zz")]


def test_extract_formulas(spark):
    # C23
    text = "DERIVED: A = b = c\nderived: x=1\nnote\nDERIVED: TRTDUR=(TRTEDT-TRTSDT).days + 1"
    df = spark.createDataFrame([(7, text)], "id int, text string")
    got = rows(extract_formulas(df, ["id"], "text"))
    assert got == [(7, 1, "A", "b = c"), (7, 4, "TRTDUR", "(TRTEDT-TRTSDT).days + 1")]


def test_conversation_log(spark):
    # C26
    df = spark.createDataFrame([(1, 0, "user", "x" * 100), (1, 1, "assistant", "y" * 101),
                                (2, 0, "user", "hi")], "conv_id long, turn long, role string, text string")
    got = rows(conversation_log(df), "conv_id", "turn", "snippet", "n_messages")
    assert got == [(1, 0, "x" * 100, 2), (1, 1, "y" * 100 + "...", 2), (2, 0, "hi", 1)]


def test_extract_fenced_and_rows_per_subject(spark):
    from tideline.operators.profile import rows_per_subject
    from tideline.operators.textjobs import extract_fenced
    df = spark.createDataFrame([(1, "```sql\nselect 1\n```")], "id int, text string")
    assert extract_fenced(df, "text", "sql").first()["block"] == "select 1"
    subj = spark.createDataFrame([("a",), ("a",), ("b",)], "s string")
    assert rows_per_subject(subj, "s").first()[0] == 1.5


def test_texts_send_each_listed_term_once_to_the_list(spark, monkeypatch):
    # X1 with a term table: what is shuffled follows what is found, not the places a term's pieces occur at
    sent = []

    def seen(many, one, many_key, one_key, how):
        sent.append(many.count())
        return many.join(one, many[many_key] == one[one_key], how)

    monkeypatch.setattr(textjobs, "join_one_per_key", seen)
    terms = ["thing", "thin", "things in", "t", "hi", "sixteen bytes it.", "sixteen bytes it", "nowhere"]
    texts = {1: "thing " * 400 + "sixteen bytes it", 2: "things in " * 300, 3: "th", 4: "sixteen bytes it. " * 5}
    df = spark.createDataFrame(list(texts.items()), "id int, text string")
    got = textjobs.screen_term_table(df, ["id"], "text", spark.createDataFrame([(t,) for t in terms], "t string"), "t")
    want = {i: sorted(t for t in terms if t in x) for i, x in texts.items()}
    assert {r["id"]: list(r["issues"]) for r in got.collect()} == want
    assert sum(len(t) <= 16 for w in want.values() for t in w) in sent


def test_terms_around_the_length_that_is_looked_up_whole(spark):
    text = "abcdefghijklmnopqrstuvwxyz é " * 2
    terms = [text[i:i + n] for n in (3, 4, 7, 8, 9, 15, 16, 17, 18, 30) for i in (0, 5, 22)] + ["x" * 16, "x" * 17, "xyz é abcdefgj"]
    df = spark.createDataFrame([(1, text), (None, text[:20]), (3, None)], "id int, text string")
    got = textjobs.screen_term_table(df, ["id"], "text", spark.createDataFrame([(t,) for t in terms], "t string"), "t")
    assert {r["id"]: list(r["issues"]) for r in got.collect()} == {
        1: sorted({t for t in terms if t in text}), None: sorted({t for t in terms if t in text[:20]}), 3: []}
