import random

from tamarack.llm import leaks, pii, quality, truncation
from tamarack.llm.holdout import CHECKED, MEASURED


def kinds(text):
    return {k for *_, k, _ in pii.spans(text)}


def found(text):
    return [(text[a:b], k) for a, b, k, _ in pii.spans(text)]


def test_personal_information_however_written():
    assert found("Mail jo.doe+x@mail.example.org or jo dot doe at mail dot example dot org.") == [("jo.doe+x@mail.example.org", "email"), ("jo dot doe at mail dot example dot org", "email")]
    assert found("me[at]shop[dot]example please")[0][1] == "email"
    for p in ("+1 312 555 0190", "+44 (0)7700 900 773", "07700 900729", "01 99 00 04 83", "030 23125 065", "(617) 555-0152", "415.555.0198", "tel:+16175550128"):
        assert kinds(f"Call me on {p} after six.") == {"phone"}, p
    for p in ("my SSN on file, 965 13 9309", "the tax id 00 476 826 833", "my NI no. QQ997716C", "passport no. X6176164", "ID card number T95195771", "driving licence MORGA657054SM9IJ"):
        assert kinds(f"It printed {p} twice.") == {"id_number"}, p
    for p in ("Flat 9, 82 Harrow Creek Street, Marrowick ZZ7 9ZZ", "27 bis rue des Tisserands, 00196 Ashpool", "Am Mühlgraben 62 in 00864 Cresswold", "Erlengasse 30, 00368 Saltmarch", "155 old mill street in wexcombe"):
        assert kinds(f"We moved to {p}.") == {"address"}, p
    for p in ("I spoke to Lena Marbeck about it.", "Thanks to Marbeck, Lena for the hint.", "Please ask for Ms Marbeck.", "It lists lena marbeck as owner.", "Regards, Lena K. Marbeck-Olsen"):
        assert kinds(p) == {"name"}, p


def test_what_is_no_personal_information():
    for t in ("Order 774 557 6388 is still open.", "Part no. 294-16-8573 is the affected item.", "The server at 192.0.2.27 answers.", "It happened at 2025-02-19 14:43:56 exactly.", "Version 7.555.0113 has it.", "The case is INC-2448305.", "The job wrote 1775885 rows.",
              "We use @tools/export@7.9.0 in the build.", "It costs 59 per seat @ 50 seats.", "Ask u/SoggyComet1277 about it.", "The Harbor Ledger plan and the Cedar Point plan both have it.", "We gave up on Nigeriper and went back.", "thanks to everyone here", "", None, "   "):
        assert pii.spans(t) == [], t


def test_redaction_is_keyed_and_distinct(spark):
    rows = [("t", 1, "Thanks to Lena Marbeck, mail lena@a.example or +44 20 7946 0248."), ("t", 2, "I spoke to LENA MARBECK and to Ivo Tarn."), ("t", 3, None), ("t", 4, "nothing here"), ("t", 1, "Thanks to Lena Marbeck, mail lena@a.example or +44 20 7946 0248.")]
    df = spark.createDataFrame(rows, "tab string, row_id long, text string")
    got = {r.row_id: r for r in pii.redact(df, b"k").collect()}
    assert got[1].redacted == "Thanks to [NAME], mail [EMAIL] or [PHONE]." and got[2].redacted == "I spoke to [NAME] and to [NAME]."
    assert set(got) == {1, 2} and "Marbeck" not in got[1].surrogate and "MARBECK" not in got[2].surrogate
    name = got[1].surrogate.split("Thanks to ")[1].split(", mail")[0]
    assert name.upper() in got[2].surrogate  # one person, one surrogate, in the format found
    assert got[1].surrogate.rsplit("or ", 1)[1][0] == "+" and len(got[1].surrogate.rsplit("or ", 1)[1]) == len("+44 20 7946 0248.")
    assert pii.redact(df, b"other").where("row_id = 1").first().surrogate != got[1].surrogate
    assert pii.redact(df.limit(0), b"k").count() == 0


def test_equal_surrogates_try_again(spark, monkeypatch):
    from tamarack.session import Scratch

    e = spark.createDataFrame([("id_number", f"{i}") for i in range(10)], "kind string, canon string")  # ten one-digit entities fill the space
    made = [r.made for r in pii._assign(e, b"k", Scratch(spark, "t")).collect()]
    assert len(set(made)) == 10


ITEM = "the night porter of the old harbour office counted nine hundred and twelve wet umbrellas before the first train left for the island"


def test_leaks_against_brute_force(spark):
    rnd = random.Random(4)
    words = [f"w{i}" for i in range(50)]
    items = [(1, ITEM), (2, " ".join(rnd.choices(words, k=40))), (3, "too short"), (4, None), (5, "opening line that several of the items share word for word here " + " ".join(rnd.choices(words, k=20)))]
    docs = []
    for d in range(120):
        src = rnd.choice([items[0][1], items[1][1], items[4][1]]).split()
        n, s = rnd.randint(8, 16), rnd.randint(0, 4)
        docs.append((d, " ".join(rnd.choices(words, k=20)) + " -- " + "_\n".join(x.upper() for x in src[s : s + n]) + "; " + " ".join(rnd.choices(words, k=5))))
    docs += [(200, None), (201, ""), (202, "word"), (203, docs[0][1]), (None, ITEM)]
    grams = lambda t: {tuple(w[i : i + 12]) for w in [leaks.words_of(t)] for i in range(len(w) - 11)}
    want = {(d, i) for d, t in docs for i, x in items if d is not None and grams(t) & grams(x)}
    df = spark.createDataFrame([(*r, "x") for r in docs], "doc_id long, text string, item_id string")
    it = spark.createDataFrame(items, "item_id long, text string")
    for size in (10_000, 60):  # one block, and several
        got = leaks.find_leaks(df, it, block_chars=size).where("shared_run").select("doc_id", "item_id").distinct().collect()
        assert {(r.doc_id, r.item_id) for r in got} == want
    assert leaks.find_leaks(df, it.limit(0)).count() == 0 and leaks.find_leaks(df.limit(0), it).count() == 0


def test_a_passage_within_the_edit_budget(spark):
    df = spark.createDataFrame([(1, ITEM.replace("hundred", "hundert"))], "doc_id long, text string")
    got = leaks.find_leaks(df, spark.createDataFrame([(1, ITEM)], "item_id long, text string"), words=12).collect()
    assert len(got) == 1 and got[0].edits <= 2


def test_banded_edits():
    """The furthest that both beginnings go with so many edits, against the full table."""
    rnd = random.Random(1)
    for _ in range(200):
        a = bytes(rnd.choices(b"abc", k=rnd.randint(0, 12)))
        b = bytes(rnd.choices(b"abc", k=rnd.randint(0, 14)))
        table = {(0, 0): 0}
        for i in range(len(a) + 1):
            for j in range(len(b) + 1):
                if i or j:
                    table[i, j] = min(table[i - 1, j - 1] + (a[i - 1] != b[j - 1]) if i and j else 99, table[i - 1, j] + 1 if i else 99, table[i, j - 1] + 1 if j else 99)
        got = leaks.reach(a, b, 3)
        assert [g[0] for g in got] == [max(i for (i, _), n in table.items() if n <= k) for k in range(4)]
        assert all(table[g] <= k for k, g in enumerate(got))


def _corpus():
    rnd = random.Random(8)
    subj, verb, obj, tail = (["the owner", "my assistant", "our developer", "the accountant"], ["checks", "prints", "forgets", "exports"], ["every invoice", "the weekly report", "all the labels", "the stock list"], ["before lunch", "on the old laptop", "without any help", "after the update"])
    return [f"{rnd.choice(subj)} {rnd.choice(verb)} {rnd.choice(obj)} {rnd.choice(tail)}" for _ in range(900)]


def test_truncation(spark):
    whole = _corpus()
    rows = [("comments", i, s + rnd) for i, (s, rnd) in enumerate(zip(whole, ["."] * 700 + [""] * 200))]
    cut = {}
    for j, (s, n) in enumerate([(whole[0], 18), (whole[1], 25), (whole[2], 14), (whole[3], 30)]):
        cut[5000 + j] = whole[50 + j] + ". " + s[:n]
    cut[5010], cut[5011] = whole[9] + ". " + whole[10][:15] + "…", whole[11][:17] + "�"
    fine = {6000: "thanks", 6001: "[deleted]", 6002: "", 6003: None, 6004: whole[5] + ".\n\nhttps://a.example/x", 6005: whole[6] + "...", 6006: whole[7] + ". cheers"}
    rows += [("comments", 7000 + i, whole[i] + ". cheers") for i in range(30)] + [("comments", 7100 + i, "thanks") for i in range(20)]
    rows += [("comments", i, t) for i, t in (*cut.items(), *fine.items())] + [("comments", 5000, cut[5000]), ("comments", None, cut[5001])]
    got = [(r.tab, r.id) for r in truncation.find_truncated(spark.createDataFrame(rows, "tab string, id long, text string")).collect()]
    assert len(got) == len(set(got))
    ids = {i for _, i in got}
    assert set(cut) <= ids and not ids & set(fine) and len(ids - set(cut)) <= 5
    assert truncation.find_truncated(spark.createDataFrame([], "tab string, id long, text string")).count() == 0


def test_near_copy_that_ends_early():
    full = "we moved the whole archive over the weekend and nobody in the branch noticed that the old shelves had been empty for a month already"
    words = full.split()
    assert truncation.ends_early(" ".join(words[:22]), full + ".")
    assert truncation.ends_early(" ".join(words[:23]) + " " + words[23][:2], full)
    assert not truncation.ends_early(full, full + ". And more.")  # the other goes on with a new sentence
    assert not truncation.ends_early(" ".join(words[:9]), full)  # not similar enough
    assert not truncation.ends_early(full, " ".join(words[:22]))


def test_quality(spark):
    off = [y for y, t in CHECKED if (quality.line_statistics(t)[quality.FEATURES.index("prose_share")] <= 0.5) != bool(y)]
    assert len(off) <= 2
    rows = [(i, t, "x") for i, (y, t) in enumerate(CHECKED * 3)] + [(900, None, "x"), (901, " \n ", "x"), (None, "text", "x"), (902, "word " * 50_000, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, words string")
    got = {r.doc_id: r for r in quality.classify(df).collect()}
    n = len(CHECKED)
    assert sum(got[i].is_prose == bool(y) for i, (y, _) in enumerate(CHECKED)) <= 2
    assert not got[900].is_prose and not got[901].is_prose and not got[902].is_prose and len(got) == 3 * n + 3
    assert quality.classify(df.limit(0)).count() == 0
    assert not set(quality.FEATURES) & set(quality.LABELLERS)
    held = spark.createDataFrame([(5000 + i, t, "x") for i, (_, t) in enumerate(MEASURED)], "doc_id long, text string, words string")
    right = {r.doc_id: r.is_prose for r in quality.classify(df.unionByName(held)).collect()}
    assert sum(right[5000 + i] == (not y) for i, (y, _) in enumerate(MEASURED)) >= len(MEASURED) - 3
    s = {r.doc_id: r for r in quality.text_statistics(df).collect()}
    assert s[900].word_count == 0 and s[900].common_words == 0.0 and s[902].word_count == 50_000
