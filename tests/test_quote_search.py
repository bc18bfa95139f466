import random
from difflib import SequenceMatcher

import pytest

from tamarack import constants as K
from tamarack.functions import quotes
from tamarack.operators import metrics as M

WORDS = "the a search field export fails when we pay for nine seats and use only two of them today because support told me".split()


def _every(q, norm, least):
    """All spans of at least that ratio, without any bound but the lengths."""
    n, m, out = len(q.split()), SequenceMatcher(autojunk=False), []
    m.set_seq2(q)
    for k, s in enumerate(norm):
        toks = s.split(" ")
        for size in range(max(1, int(n * K.SPAN_LOW)), int(n * K.SPAN_HIGH) + 1):
            for i in range(len(toks) - size + 1):
                a = len(" ".join(toks[:i])) + (i > 0)
                b = a + len(" ".join(toks[i : i + size]))
                if K.SPAN_LOW * len(q) <= b - a <= K.SPAN_HIGH * len(q):
                    m.set_seq1(s[a:b])
                    if m.real_quick_ratio() >= least and (r := m.ratio()) >= least:
                        out.append((r, k, a, b))
    return out


@pytest.mark.parametrize("indexed", [0, 30_000])
def test_bounds_lose_no_span(monkeypatch, indexed):
    monkeypatch.setattr(quotes, "INDEXED", indexed)
    rnd, found = random.Random(4), 0
    some = lambda n: " ".join(rnd.choice(WORDS) for _ in range(n))

    def changed(s):
        s = list(s)
        for _ in range(rnd.randrange(14)):
            i = rnd.randrange(len(s))
            s[i : i + rnd.randrange(2)] = rnd.choice(["x", "", "b", " ", "q"])
        return "".join(s)

    for _ in range(25):
        q = some(rnd.randrange(4, 22))
        norm = [" ".join(f"{some(rnd.randrange(9))} {changed(q) if rnd.random() < 0.5 else ''} {some(rnd.randrange(9))}".split()) for _ in range(12)]
        src = quotes.Sources(norm)
        assert src.exact(q) == next((k for k, s in enumerate(norm) if q in s), None)
        for least in (quotes.needed(len(q.split())), quotes.needed(len(q.split())) - K.FUZZY_MARGIN):
            spans = _every(q, norm, least)
            found += bool(spans)
            got, want = src.near(q, least), spans and quotes._unique(spans)
            assert got == ((want[0][0], want[0][1], want[1], *want[0][2:]) if spans else None)
    assert found > 10


def test_span_with_a_change_in_every_word():
    source = "the xsearch xfields xexport xalways xfails xwhenever xseveral xpeople xupload xattached xinvoices xtogether"
    assert quotes.find_near("the search fields export always fails whenever several people upload attached invoices together", [(7, source)]) == (7, source)


def test_plain_is_normalised():
    rnd = random.Random(2)
    for _ in range(3000):
        s = "".join(rnd.choice("aB *_`\n\t\xa0’“—ΣİßσςÉ\x1c\x85z") for _ in range(rnd.randrange(14)))
        assert quotes.plain(s) == quotes.normalised(s)[0]


def test_blocks_of_a_post_agree(spark, monkeypatch):
    bodies = [f"filler {i} says that exports lose every second row here" for i in range(12)] + ["we pay for nine seats and use only two of them today", "support told me to wait for the next release and then closed the case"]
    posts = spark.createDataFrame([(1, "Title", "")], "id long, title string, selftext string")
    comments = spark.createDataFrame([(100 + i, 1, i, b) for i, b in enumerate(bodies)], "id long, post_id long, score long, body string")
    rows = [(1, 1, 100, "we pay for nine seats and use onlyy two of them today"), (2, 1, 100, "exports lose every secnd row here"), (3, 1, 100, "exports lose every second row"), (4, 1, 113, "support told me to wait for the next release and then clsed the case")]
    pendings = spark.createDataFrame(rows, "id long, post_id long, comment_id long, quoted_text string")
    want = [(i, *quotes.repair(q, c, [(None, "Title\n"), *((100 + k, b) for k, b in sorted(enumerate(bodies), reverse=True))])) for i, _, c, q in rows]
    assert [w[1] for w in want] == [True, False, True, True]
    for block in (3, 1000):
        monkeypatch.setattr(quotes, "BLOCK", block)
        assert sorted(map(tuple, quotes.repair_quotes(pendings, posts, comments).collect())) == want


def test_quote_status_by_blocks(spark, monkeypatch):
    monkeypatch.setattr(quotes, "BLOCK", 4)
    monkeypatch.setattr(quotes, "INDEXED", 10)
    posts = spark.createDataFrame([(1, "Title", "the post"), (2, "Other", None)], "id long, title string, selftext string")
    comments = spark.createDataFrame([(100 + i, 1, f"Filler *{i}*  says\nnothing of interest") for i in range(20)] + [(120, 2, None)], "id long, post_id long, body string")
    rows = [(1, 1, 103, "filler 3 says"), (2, 1, 103, "FILLER 17 says nothing"), (3, 1, None, "the post"), (4, 1, 104, "the post"), (5, 1, None, "interest filler"), (6, 2, None, "filler 3"), (7, 1, None, " "), (8, 9, None, "filler 3"), (9, 1, None, "19"), (9, 1, None, "no such words"), (10, None, None, "filler 3")]
    pendings = spark.createDataFrame(rows, "id long, post_id long, comment_id long, quoted_text string")
    got = sorted(map(tuple, M.quote_status(pendings, posts, comments).collect()))
    assert got == [(1, "attributed"), (2, "other_comment"), (3, "attributed"), (4, "post"), (5, "missing"), (6, "missing"), (7, "blank"), (8, "missing"), (9, "missing"), (9, "other_comment"), (10, "missing")]
