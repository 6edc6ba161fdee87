from tallyloom.llm import leaks as L

ITEM = "one two three four five six seven eight nine ten eleven twelve"
DOC = "doc_id bigint, text string, item_id string, n_spans int"
TEST = "item_id bigint, text string, doc_id int"


def found(spark, docs, items, n=10):
    d = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], DOC)
    t = spark.createDataFrame([(i, x, 1) for i, x in items], TEST)
    return {(r.item_id, r.doc_id): (r.n_spans, r.longest_run, r.covered_words) for r in L.find_leaks(d, t, n=n).collect()}


def test_runs_of_words(spark):
    docs = [
        (1, "Start. ONE, two-three four fi​ve six; seven eight nine TEN end"), (2, "one two three four five six seven eight nine"), (3, f"x {ITEM} y {ITEM}"), (4, None), (5, ""),
        (6, "one two three four five six seven eight nine zehn eleven twelve"), (7, "one two three four five six seven eight nine ten " * 3), (None, ITEM), (3, f"x {ITEM} y {ITEM}"),
    ]
    got = found(spark, docs, [(1, ITEM), (2, "too short"), (3, None), (4, "")])
    assert got == {(1, 1): (1, 10, 10), (1, 3): (2, 12, 24), (1, 7): (3, 10, 30)}
    assert found(spark, [], [(1, ITEM)]) == {} and found(spark, docs, []) == {}


def test_equals_brute_force(spark, small_dir):
    from tallyloom.llm.queries import p8_found

    got = {tuple(r) for r in p8_found(spark, small_dir).collect()}
    docs = [(r.doc_id, L.words_of(r.text)) for r in spark.read.parquet(f"{small_dir}/documents.parquet").where("text is not null").collect()]
    want = set()
    for item in spark.read.parquet(f"{small_dir}/eval_items.parquet").where("text is not null").collect():
        w = L.words_of(item.text)
        grams = {tuple(w[i : i + 10]) for i in range(len(w) - 9)}
        want |= {(item.item_id, d) for d, x in docs if any(tuple(x[i : i + 10]) in grams for i in range(len(x) - 9))}
    assert got == want and got


def test_clean_documents_and_blocks(spark, monkeypatch):
    d = spark.createDataFrame([(1, ITEM), (2, "clean")], "doc_id bigint, text string")
    t = spark.createDataFrame([(1, ITEM)], "item_id bigint, text string")
    assert [r.doc_id for r in L.without_leaks(d, L.find_leaks(d, t)).collect()] == [2]
    # A test side beyond one block gives what a single one gives, and only the cutting of spans still raises.
    import pytest

    many = spark.createDataFrame([(i, " ".join(f"w{i}x{j}" for j in range(12))) for i in range(40)], "item_id bigint, text string")
    docs = spark.createDataFrame([(i, f"so w{i}x0 " + " ".join(f"w{i}x{j}" for j in range(12)) + " w") for i in range(0, 40, 3)], "doc_id bigint, text string")
    whole = {tuple(r) for r in L.find_leaks(docs, many).collect()}
    monkeypatch.setattr(L, "BLOCK_CHARS", 500)
    assert {tuple(r) for r in L.find_leaks(docs, many).collect()} == whole and len(whole) == 14
    with pytest.raises(ValueError):
        L.without_spans(docs, many)


def test_control_characters_are_invisible_in_any_text():
    assert L.words_of("fo\x00o bar") == ["foo", "bar"] and L.words_of("fo\x00o bär") == ["foo", "bär"] and L.words_of("a\tb\nc") == ["a", "b", "c"]


def test_very_long_text():
    index = L.TestGrams([(1, ITEM)], 10)
    assert index.spans("word " * 300_000 + ITEM) == [(1, 300_000, 300_012)]


def test_cutting_spans(spark):
    index = L.TestGrams([(1, ITEM)], 10)
    assert L.cut_spans("Before, ONE two three four fi\u200bve six seven eight nine ten! After.", index) == ("Before, ! After.", 10)
    assert L.cut_spans(ITEM, index) == ("", 12) and L.cut_spans("clean\u200b text", index) == ("clean\u200b text", 0)
    overlapping = L.TestGrams([(1, "a b c d e"), (2, "c d e f g")], 3)
    assert L.cut_spans("x a b c d e f g y", overlapping) == ("x y", 7)
    df = spark.createDataFrame([(1, f"keep {ITEM} this"), (2, None)], "doc_id bigint, text string")
    tests = spark.createDataFrame([(1, ITEM)], "item_id bigint, text string")
    assert [tuple(r) for r in L.without_spans(df, tests).orderBy("doc_id").collect()] == [(1, "keep this", 12), (2, None, 0)]
