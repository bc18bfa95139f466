import random

from tamarack.llm import leaks


def _word(rng, short):
    return "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(1, 4) if short else rng.randrange(4, 10)))


def test_every_passage_within_the_edit_budget_is_found(spark):
    """Planted passages of twelve to twenty words with up to two edited characters, items of short and of long words together,
    in one block and in many: recall against what was planted is 1, and nothing is found twice."""
    rng = random.Random(8)
    items = [(i, [_word(rng, i % 4 == 0) for _ in range(rng.randrange(20, 60))]) for i in range(60)]
    docs, want = [], set()
    for d in range(240):
        words = [_word(rng, False) for _ in range(rng.randrange(30, 120))]
        if d % 3:
            i, w = rng.choice(items)
            n = rng.randrange(14, 20)
            at = rng.randrange(len(w) - n + 1)
            part = list(" ".join(w[at : at + n]))
            for _ in range(d % 3):
                k = rng.randrange(len(part))
                part[k] = rng.choice(["", "x", part[k] + "y"]) if part[k] != " " else " "
            words[10:10] = ["".join(part)]
            want.add((d, i))
        docs.append((d, ",  ".join(words).upper() if d % 5 == 0 else " ".join(words)))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    it = spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id long, text string")
    for size in (2_000_000, 3_000):
        got = [(r.doc_id, r.item_id) for r in leaks.find_leaks(df, it, block_chars=size).collect()]
        assert len(got) == len(set(got)) and want <= set(got)


def test_sift_reads_words_as_the_match_does():
    import pyarrow as pa

    texts = ["Straße  und_Öl, 12½ km!", "ÇA VA? l'été — naïve", " \n", "Привет, МИР"]
    assert leaks._joined(pa.array(texts)).to_pylist() == [" ".join(leaks.words_of(t)) for t in texts]
