from pyspark.sql import functions as F

from tamarack.llm import truncation
from tamarack.session import Scratch


def test_hot_bucket_compares_all(spark):
    """An edit in the beginning hides no near-copy, and a longer text that begins alike stands before none, however full the bucket."""
    body = [f"word{i}" for i in range(60)]
    edited = ["other", *body[1:]]
    texts = [" ".join([*body, f"tail{i}."]) for i in range(90)] + [" ".join(edited[:55])]
    rows = spark.createDataFrame([("t", i, t) for i, t in enumerate(texts)], "tab string, id long, text string")
    rows = rows.withColumn("th", F.xxhash64("text")).withColumn("n", F.length("text"))
    near = truncation._near_copies(truncation._parse(rows), Scratch(spark, "test")).collect()
    assert [r.th for r in near] == [rows.where("id = 90").first().th]


def test_blocks_of_a_large_bucket_lose_no_pair(spark, monkeypatch):
    """With blocks of seven texts the same pairs are met as within whole buckets."""
    word = lambda i: chr(97 + i % 26) * 3 + chr(97 + i // 26) * 2  # noqa: E731  any number counts as one
    texts = [" ".join([*map(word, range(40)), "tail" + word(i), "more" if i % 2 else "end."]) for i in range(60)]
    rows = spark.createDataFrame([("t", i, t) for i, t in enumerate(texts + texts[:20])], "tab string, id long, text string")
    parsed = truncation._parse(rows.withColumn("th", F.xxhash64("text")).withColumn("n", F.length("text")))
    met, met_in = [], truncation._met
    for block in (1024, 7):
        monkeypatch.setattr(truncation, "BLOCK", block)
        monkeypatch.setattr(truncation, "_met", lambda rows: (met.append({(r.ta, r.tb) for r in met_in(rows).collect()}), met_in(rows))[1])
        truncation._near_copies(parsed, Scratch(spark, "test"))
    assert met[0] == met[1] and len(met[0]) >= 0.9 * 30 * 30  # those that end alike are left out
