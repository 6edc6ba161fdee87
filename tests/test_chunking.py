from pyspark.sql import functions as F

from tallyloom.operators import chunking as C


def test_word_budget_carries_whole_sentences():
    text = " ".join(f"Sentence number {i} has exactly seven words." for i in range(20))
    rows = list(C.Packer(C.word_budget(30, 10)).run([C.Element("narrative", text, 1)]))
    assert all(r["word_count"] <= 30 for r in rows)
    assert not rows[0]["overlap_with_previous"] and all(r["overlap_with_previous"] for r in rows[1:])
    assert rows[1]["text"].startswith("Sentence number 3")
    assert [r["chunk_index"] for r in rows] == list(range(len(rows)))


def test_tables_are_atomic_and_paths_follow_headings():
    els = [C.Element("heading", "MEANS OF ESCAPE", 1), C.Element("heading", "Doors", 1), C.Element("narrative", "One door is here.", 2), C.Element("table", "| a |\n|---|\n| 1 |", 3), C.Element("heading", "WATER", 4)]
    rows = list(C.Packer(C.word_budget()).run(els))
    assert [r["contains_table"] for r in rows] == [False, True, False]
    assert rows[0]["section_path"] == ["MEANS OF ESCAPE", "Doors"] and rows[2]["section_path"] == ["WATER"]
    assert (rows[0]["page_start"], rows[0]["page_end"]) == (1, 2)


def test_token_budget_is_never_passed():
    count = lambda s: len(s.split())
    rules = C.token_budget(12, 3, 2, count)
    long = " ".join(f"w{i}" for i in range(35)) + "."
    rows = list(C.Packer(rules).run([C.Element("narrative", "A b c d. E f g h. " + long, 1), C.Element("table", "| h |\n|---|\n" + "\n".join(f"| r {i} |" for i in range(9)), 2)]))
    assert all(count(r["text"]) <= 10 for r in rows)
    parts = [r for r in rows if r["sub_of"] == "sentence"]
    assert [r["sub_index"] for r in parts] == list(range(4)) and {r["sub_count"] for r in parts} == {4}
    assert all(r["text"].startswith("| h |\n|---|") for r in rows if r["sub_of"] == "table")


def test_structure_keeps_elements_whole():
    count = lambda s: len(s.split())
    rows = list(C.Packer(C.structure_aware(10, 0, count)).run([C.Element("narrative", "one two three four.", 1), C.Element("narrative", "five six seven.", 1), C.Element("narrative", "eight nine ten eleven.", 2), C.Element("narrative", "A b c d e f. G h i j k l m.", 3)]))
    assert rows[0]["text"] == "one two three four.\n\nfive six seven." and rows[1]["text"] == "eight nine ten eleven."
    assert [r["sub_of"] for r in rows[2:]] == ["sentence", "sentence"]


def test_pages_with_nulls_and_repeats(spark):
    pages = spark.createDataFrame([("d", 1, "Hello there my friend. It is late."), ("d", 1, "Hello there my friend. It is late."), ("d", None, None), ("e", 2, ""), (None, 1, "lost")], "document string, page int, text string")
    got = C.chunk_documents(pages, C.word_budget()).collect()
    assert [(r.document, r.chunk_index, r.page_start) for r in got] == [("d", 0, 1)]
    assert C.chunk_documents(pages.limit(0), C.word_budget()).count() == 0


def test_blocks():
    assert C.blocks_of("one\ntwo\n\nthree") == ["one\ntwo", "three"] or C.blocks_of("one\ntwo\n\nthree") == ["one two", "three"]
    assert C.blocks_of("- a\n- b") == ["- a", "- b"]
    assert C.table_like("a  b\nc  d") and not C.table_like("plain\ntext")


def test_words_beyond_the_budget_are_cut():
    by_two = lambda s: sum(-(-len(w) // 2) for w in s.split())
    assert C.split_words("ab " + "x" * 21 + " cd", by_two, 4) == ["ab", "xxxxxxxx", "xxxxxxxx", "xxxxx cd"]
    assert C.split_word("é", lambda s: 9, 4) == ["é"] and C.split_word("", by_two, 4) == [""]
    assert all(by_two(p) <= 4 for p in C.split_words("y" * 1001 + " z", by_two, 4))


def test_strategies_share_one_parse(spark):
    texts = ["GENERAL\n\n" + " ".join(f"Door {i} of flat {j} closes, but not fully." for i in range(80)) for j in range(3)] + ["a | b\n1 | 2\n" * 90, "- one\n- two", None]
    pages = spark.createDataFrame([(f"d{n % 2}", n, t) for n, t in enumerate(texts)] + [(None, 1, "lost")], "document string, page int, text string")
    rules = {"words": C.word_budget(30, 10), "tokens": C.token_budget(40, 9), "structure": C.structure_aware(40)}
    got = C.chunk_strategies(pages, rules)
    assert got._jdf.queryExecution().optimizedPlan().toString().count("MapInPandas") == 1
    for name, rule in rules.items():
        want = C.chunk_documents(pages, rule)
        assert got.where(F.col("strategy") == name).drop("strategy").exceptAll(want).isEmpty() and got.where(F.col("strategy") == name).count() == want.count() > 10


def test_atoms_are_counted_once():
    seen = []
    rules = C.token_budget(40, 9, 2, lambda s: seen.append(s) or len(s.split()))
    list(C.Packer(rules).run([C.Element("heading", "WATER", 1), C.Element("narrative", "One door is here. Two are there.", 1)]))
    assert seen == ["WATER", "One door is here.", "Two are there."]
