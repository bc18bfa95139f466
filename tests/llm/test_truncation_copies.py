from tamarack.llm import truncation


def test_copies_of_a_cut_text_do_not_vouch_for_each_other(spark):
    words = "we moved the whole team over in spring because the old tool kept losing our notes and nobody answered the tickets we wrote about it for weeks on end".split()
    full, cut = " ".join(words) + ".", " ".join(words[:-3])
    rows = spark.createDataFrame([("t", i, full) for i in range(20)] + [("t", 100 + i, cut) for i in range(8)], "tab string, id long, text string")
    got = {r.id: r.evidence for r in truncation.find_truncated(rows).collect()}
    assert got == {100 + i: "near_copy" for i in range(8)}


def test_a_copy_that_stops_inside_a_word_is_found_by_its_copy_alone(spark, monkeypatch):
    """Closing words that end well elsewhere hide no cut that a near-copy shows; without the search the row isn't found."""
    words = "the export of invoices takes an hour every night and our accountant has to wait for it before she can close the books of the week and go".split()
    cut = " ".join([*words, "in"])
    rows = [("t", 0, " ".join([*words, "into town, hungry."])), ("t", 1, cut)]
    rows += [("t", 10 + i, f"Reply number {i} from shop {i * 7}.\n{cut}.") for i in range(20)]
    df = spark.createDataFrame(rows, "tab string, id long, text string")
    assert {(r.id, r.evidence) for r in truncation.find_truncated(df).collect()} == {(1, "near_copy")}
    none = spark.createDataFrame([], "th long, in_word boolean")
    monkeypatch.setattr(truncation, "_near_copies", lambda *_: none)
    assert truncation.find_truncated(df).count() == 0
