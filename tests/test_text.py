from pyspark.sql import functions as F

from tallyloom.functions import arrays as A
from tallyloom.functions import text as X


def one(spark, value, expr, kind="string"):
    return spark.createDataFrame([(value,)], f"c {kind}").select(expr(F.col("c")).alias("x")).first()["x"]


def test_match_key(spark):
    assert one(spark, '  "What  is\tIT?" ', X.match_key) == "what is it?"
    assert one(spark, None, X.match_key) == ""


def test_normalise_and_shingles(spark):
    assert one(spark, "<b>A/B</b> | 5.1%  m² é!", X.normalise_for_match) == "a/b 5.1% m² é"
    grams = lambda c: X.shingles(X.blank_tokens(c), 5)
    assert one(spark, "a b c d e f", grams) == ["a b c d e", "b c d e f"]
    assert one(spark, "a b", grams) == ["a b"]
    assert one(spark, "", grams) == []


def test_refusals_and_labels(spark):
    assert one(spark, "There is Insufficient information.", X.refused_by_net) is True
    assert one(spark, "The door is FD30.", X.refused_by_net) is False
    assert one(spark, X.ABSTENTION_MARKER.upper(), X.marker_match) is True
    assert [one(spark, s, X.coerce_label) for s in (" Yes", "hallucinated", "maybe", None)] == [1, 0, None, None]


def test_tables_lists_and_blocks(spark):
    assert one(spark, "| a | b |\n| 1 | 2 |", X.looks_like_table) is True
    assert one(spark, "Just one line", X.looks_like_table) is False
    assert one(spark, "- first\n- second", X.is_bulleted) is True
    assert one(spark, "MEANS OF ESCAPE", X.classify_block) == "heading"
    assert one(spark, "The door was checked and it was found to close fully. It was then signed off by the agent.", X.classify_block) == "narrative"
    assert one(spark, "a\n\nb\n\n\n\nc", lambda c: F.round(X.blank_line_ratio(c), 4)) == 0.5714


def test_policies(spark):
    assert one(spark, "sentence_w310_o62", X.policy_unit) == "words"
    assert one(spark, "fixed_t256_o64", X.policy_family) == "fixed"
    assert one(spark, "0", X.coerce_page) == 1 and one(spark, "7", X.coerce_page) == 7


def test_entities(spark):
    assert one(spark, "caf&amp;#233;", X.unescape_twice) == "café"


def test_numbers(spark):
    assert one(spark, "[1, 2.5]", A.json_numbers) == [1.0, 2.5]
    assert one(spark, '{"k": 7}', lambda c: A.json_count(c, "$.k")) == 7
    assert one(spark, '{"k": "x"}', lambda c: A.json_count(c, "$.k")) is None
    assert one(spark, "GPU 12.5 W, CPU 7.5 W", A.parse_watts) == 20.0
    assert one(spark, 0.02, lambda c: A.bonferroni(c, 3), "double") == 0.06 and one(spark, None, lambda c: A.bonferroni(c, 3), "double") is None


def test_hooks(spark):
    from tallyloom.functions import hooks

    df = spark.createDataFrame([(1, "red door"), (2, None), (3, "")], "id int, t string")
    got = {r.id: r for r in df.select("id", hooks.embedding_udf()("t").alias("v"), hooks.token_count_udf(specials=2)("t").alias("n")).collect()}
    assert abs(sum(x * x for x in got[1].v) - 1) < 1e-5 and got[2].v is None and set(got[3].v) == {0.0}
    assert [got[i].n for i in (1, 2, 3)] == [4, 0, 0]


def test_context(spark):
    from tallyloom.operators.context import name_matches, rendered_context

    df = spark.createDataFrame([("m", 1, "A", 3, "two"), ("m", 0, "A", None, "one"), ("m", 2, "B", 1, None)], "m string, r int, d string, p int, t string")
    assert rendered_context(df, "m", "r", "d", "p", "t").first().context == "Document: A\none\n\nPage 3: two\n\nDocument: B\nPage 1: "
    names = spark.createDataFrame([("x/A.pdf", "a.PDF")], "n string, w string")
    got = names.select(*(name_matches(F.col("n"), F.col("w"), how) for how in ("exact", "casefold", "basename", "contains"))).first()
    assert list(got) == [False, False, True, True]
