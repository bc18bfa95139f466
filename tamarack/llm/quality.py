"""Per-document text quality statistics, and prose told from lists, tables and junk.

The plain statistics are column expressions. The classifier's features describe lines, pieces and characters. Weak labels
come from three sources that are no features: the share of words that lists lack, how many words go to a sentence's end, and the share
of lines that end as sentences do; a document gets one where two agree and none objects. Gradient-boosted trees learn them on
a bounded sample (TRAIN_ROWS of each label) together with a few hand-labelled seeds, and the trees' margin becomes a
probability on other hand-checked texts. Every document is scored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import Scratch
from .holdout import CHECKED, SEEDS

TRAIN_ROWS = 5000
SEED = 11
#: What a text labelled by hand weighs against one labelled weakly.
SEED_WEIGHT = 5.0

# fixed values: frequent function words of en, de, fr and es
COMMON = tuple(
    """a about after all also am an and any are as at be been but by can do every for from had has have he how i if in is it its just me more my no not now of on one or our out she so some than that the their them then there they this to up us was we what when which who will with would you your
aber auch auf aus bei das dem den der des die doch ein eine es für hat ich im ist mit nach nicht noch sich sind so um und uns von wir wird zu zum
au avec ce cette dans de des du elle en est et il je la le les mais ne nous on ou par pas pour qui que se sur un une
al como con del el en es esta la las lo los más no nos para pero por que se sin su un una y ya""".split()
)
_COMMON = frozenset(COMMON)
# fixed values: those of them that lists of things hold as well
_OF_LISTS = frozenset("a an the of for on by with to in at from and or der die das dem den des ein eine mit von zum zur für und au de des du le la les un une en et pour el los las del una con y".split())
# fixed values: further words that only sentences have
_RUNNING = (_COMMON - _OF_LISTS) | frozenset(
    """i'm it's don't me him us could were did does too very while yet still only even because when until since before after where whose each any many much nobody everyone
habe haben hatte war waren wurde werden wirklich seit dass weil wenn jede jeder jeden niemand immer schon nur auch man kann muss alles nichts uns unser unsere bis wie zwei
ai avons cela nous notre nos sont était très rien tout même fait depuis chaque personne toujours mais aussi quand où comme si tient tenons coûte
ha han he hay esto este ese muy nos nuestro nuestra tiene cuando cada siempre nadie todo nada fue son está mientras desde hasta ya solo cuesta mismo""".split()
)
WORD = r"[\p{L}\p{N}]+"


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a.cast("double") / b).otherwise(F.lit(0.0))


def text_statistics(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """word_count, mean_word_length, symbol_ratio (characters that are no letter, digit or white space), punctuated_lines
    (share of non-blank lines that end in . ! ? : or a quote after these) and common_words (share of words).

    A null or empty text has 0 for all; nothing is divided by zero. Columns of df other than ``keep`` are left out.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    words = F.regexp_extract_all(F.lower(t), F.lit(f"({WORD})"), 1)
    lines = F.filter(F.split(t, "\n"), lambda x: F.length(F.trim(x)) > 0)
    df = df.select(*keep, F.length(t).alias("chars"), words.alias("words"), lines.alias("lines"), F.length(F.regexp_replace(t, r"[\p{L}\p{N}\s]", "")).alias("symbols"))
    n = F.size("words")
    return df.select(
        *keep,
        n.cast("long").alias("word_count"),
        _ratio(F.aggregate("words", F.lit(0).cast("long"), lambda a, w: a + F.length(w)), n).alias("mean_word_length"),
        _ratio(F.col("symbols"), F.col("chars")).alias("symbol_ratio"),
        _ratio(F.size(F.filter("lines", lambda x: F.rtrim(x).rlike(r"[.!?:][\"')\]]*$"))), F.size("lines")).alias("punctuated_lines"),
        _ratio(F.size(F.filter("words", lambda w: w.isin(*COMMON))), n).alias("common_words"),
    )


FEATURES = ("words", "word_len", "symbols", "digits", "prose_share", "list_share", "table_share", "markup_share", "short_share", "repeat_share", "unique", "odd", "lines", "wide", "longest_run", "item_words")
#: What the weak labels are read from; none of these is a feature.
LABELLERS = ("running", "sentence_words", "punctuated")
_W = re.compile(r"[^\W_]+")
_LETTERS = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*")
_ITEM = re.compile(r"\s*(?:[-*•·▪‣–—+]|\d{1,3}[.)]|[a-z][.)]|\[[ x]\]|☐|☑|✓)\s+(?:\[[ xX]\]\s*)?")
_LEAD = re.compile(r"\s*(?:>+\s*|--\s*reply:\s*|u/[\w-]+:\s*|\[[A-Z]+[^\]]*\]\s*|[QA]:\s*|\d{1,3}[.)]\s+|[-*•–]\s+)*")
_TAIL = re.compile(r"\s*\((?:[a-z]+, )?score -?\d+\)\s*$")
_MARKUP = re.compile(r"</?\w+[^>]*>|&\w+;|\{[^}]*\}|\[/?\w+\]|0x[0-9a-f]+|[0-9a-f]{8,}|https?://\S+|\w+=\"?[\w-]+\"?|\\[nrtux]|==+|~~+|\$\w+|\w+\(\)")
_EMPHASIS = re.compile(r"[*_`~]+")
_GAP = re.compile(r"\S {2,}\S")
_SENTENCE_END = re.compile(r"[.!?…]+[\"')\]»”]*(?:\s|$)")
_SYMBOL = re.compile(r"[^\w\s]|_")
_ODD_MARK = re.compile(r"[^\w\s.,;:!?'’\"\-()–]|_")
_NUMERAL = re.compile(r"\d")
_HIGH = re.compile(r"[^\x00-\x7e\w]")
_RUN = re.compile(r"(\S)\1+")
_PIECE = re.compile(r"[|;│\t]|, ")
_SEP = re.compile(r"\s[|;/›»>·•]\s|[|│;\t]|,(?=\S)")


def _prose(line: str) -> float:
    """How much a line reads as running sentences, from 0 to 1."""
    body = _TAIL.sub("", _LEAD.sub("", line, count=1).strip().strip('"“”'))
    body = _EMPHASIS.sub("", body)
    words = _LETTERS.findall(body)
    if len(words) < 3 or not body:
        return 0.0
    low = [w.lower() for w in words]
    common = sum(w in _COMMON for w in low) / len(words)
    ends = len(_SENTENCE_END.findall(body))
    seps = len(_SEP.findall(body)) + body.count(",") * (ends == 0) * 0.5
    symbols = len(_ODD_MARK.findall(body)) / len(body)
    if symbols > 0.12 or seps / len(words) > 0.13 or len(_MARKUP.findall(body)) / len(words) > 0.2 or len(_NUMERAL.findall(body)) / len(body) > 0.2:
        return 0.0
    if Counter(low).most_common(1)[0][1] / len(words) > 0.34 and len(words) > 8:
        return 0.0
    if ends and len(words) >= 3:
        return 1.0 if common >= 0.1 or len(words) / ends >= 4 else 0.5
    if len(words) >= 7:
        return 1.0 if common >= 0.2 else 0.2 if common >= 0.1 else 0.0
    return 0.0


def line_statistics(text: str | None) -> list[float]:
    """FEATURES and then LABELLERS of one text; zeros for one without a visible character."""
    t = text or ""
    lines = [x for x in t.split("\n") if x.strip()]
    if not lines:
        return [0.0] * (len(FEATURES) + len(LABELLERS))
    # a line that goes on in the next one: it ends in a blank, or wide lines without an end that run on in small letters
    joined: list[str] = []
    wide = [len(x) for x in lines if len(x) >= 40]
    for x in lines:
        if joined and not _ITEM.match(x) and not _SENTENCE_END.search(joined[-1][-4:]) and (joined[-1].endswith(" ") or (len(lines[0]) >= 40 and len(wide) > len(lines) // 2 and x[:1].islower() and not _SEP.search(x) and not _GAP.search(x))):
            joined[-1] += x if joined[-1].endswith(" ") else " " + x
        else:
            joined.append(x)
    if t.count("\t") + t.count("\xa0") >= 3 or (len(lines) >= 8 and sum(len(x.split()) for x in lines) / len(lines) < 9 and len(_SENTENCE_END.findall(t)) and not any(_ITEM.match(x) or "|" in x or ";" in x for x in lines)):
        flat = " ".join(t.split())  # broken by stray white space: one text if its words are those of sentences
        w = [x.lower() for x in _LETTERS.findall(flat)]
        if w and len(w) / (len(_SENTENCE_END.findall(flat)) + 1) >= 6 and sum(x in _COMMON for x in w) / len(w) >= 0.25 and len(set(map(str.strip, lines))) > 0.7 * len(lines):
            joined = [flat]
    chars = sum(len(x.strip()) for x in joined)
    count = Counter(x.strip() for x in joined)
    share = lambda ok: sum(len(x.strip()) for x in joined if ok(x)) / chars
    words = _W.findall(t)
    low = [w.lower() for w in words]
    n = max(1, len(words))
    repeated = lambda x: count[x.strip()] > 2
    pieces = [p for x in joined for p in _PIECE.split(x) if p.strip()]
    runs = max((len(m.group()) for m in _RUN.finditer(t)), default=1)
    ends = len(_SENTENCE_END.findall(t))
    return [
        float(len(words)), sum(map(len, words)) / n, len(_SYMBOL.findall(t)) / len(t), len(_NUMERAL.findall(t)) / len(t),
        sum(_prose(x) * len(x.strip()) * (not repeated(x)) for x in joined) / chars, share(lambda x: bool(_ITEM.match(x))), share(lambda x: len(_SEP.findall(x)) >= 2),
        min(1.0, sum(len(m.group()) for m in _MARKUP.finditer(t)) / len(t)), share(lambda x: len(x.split()) <= 6), share(repeated),
        len(set(low)) / n, len(_HIGH.findall(t)) / len(t), float(len(joined)), sum(map(len, joined)) / len(joined), float(min(runs, 50)),
        sum(len(p.split()) for p in pieces) / max(1, len(pieces)),
        sum(w in _RUNNING for w in low) / n, len(words) / (ends + 1), sum(bool(_SENTENCE_END.search(_TAIL.sub("", x.rstrip())[-4:])) for x in joined) / len(joined),
    ]


def weak_label(running: float, sentence_words: float, punctuated: float) -> int | None:
    """1 junk, 0 prose, None where fewer than two sources say so or one says the contrary. As many words of running text as only
    sentences have say prose by themselves, for careless writers leave out all punctuation."""
    says = [
        0 if running >= 0.15 else 1 if running <= 0.06 else None,
        0 if 3 <= sentence_words <= 24 else 1 if sentence_words > 30 or sentence_words < 1 else None,
        0 if punctuated >= 0.5 else 1 if punctuated <= 0.05 else None,
    ]
    if running >= 0.2:
        return 0
    for label in (0, 1):
        if says.count(label) >= 2 and says.count(1 - label) == 0:
            return label
    return None


def _featured(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [line_statistics(t) for t in b.column(1).to_pylist()]
            cols = list(zip(*rows)) if rows else [[]] * (len(FEATURES) + len(LABELLERS))
            weak = pa.array([weak_label(*r[len(FEATURES) :]) for r in rows], pa.int32())
            yield pa.RecordBatch.from_arrays([b.column(0), weak, *[pa.array(c, pa.float64()) for c in cols[: len(FEATURES)]]], ["doc_id", "weak", *FEATURES])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).where("doc_id is not null").mapInArrow(scan, "doc_id long, weak int, " + ", ".join(f"{f} double" for f in FEATURES))


def classify(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", train_rows: int = TRAIN_ROWS) -> DataFrame:
    """(doc_id, junk_probability, is_prose) of every document with an id; a null or blank text isn't prose (probability 1).

    Repeated rows come out repeatedly. Documents without a weak label are scored like the others; where no document has one,
    the seeds alone train the trees.
    """
    from pyspark.ml.classification import GBTClassifier, LogisticRegression
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    spark = docs.sparkSession
    rows = Scratch(spark, "quality").write(_featured(docs, doc_id, text), "features")
    counts = {r.weak: r.n for r in rows.where("weak is not null").groupBy("weak").agg(F.count("*").alias("n")).collect()}
    put = VectorAssembler(inputCols=list(FEATURES), outputCol="x")
    rate = F.lit(0.0)
    for label, n in counts.items():
        rate = F.when(F.col("weak") == label, min(1.0, train_rows / n)).otherwise(rate)
    draw = F.pmod(F.xxhash64("doc_id", F.lit(SEED)), F.lit(1_000_000)) / 1_000_000

    def by_hand(texts: tuple) -> DataFrame:
        got = [(*line_statistics(t)[: len(FEATURES)], float(y)) for y, t in texts]
        return spark.createDataFrame(got, ", ".join(f"{f} double" for f in FEATURES) + ", label double")

    sample = rows.where("weak is not null").where(draw < rate).select(*FEATURES, F.col("weak").cast("double").alias("label"), F.lit(1.0).alias("weight"))
    sample = sample.unionByName(by_hand(SEEDS).withColumn("weight", F.lit(SEED_WEIGHT)))
    drawn = [min(train_rows, counts.get(y, 0)) + SEED_WEIGHT * sum(s == y for s, _ in SEEDS) for y in (0, 1)]  # both labels weigh alike
    sample = put.transform(sample.withColumn("weight", F.when(F.col("label") == 1, F.col("weight") * (drawn[0] / drawn[1])).otherwise(F.col("weight"))))
    sample = sample.select("x", "label", "weight").coalesce(4).cache()
    trees = GBTClassifier(featuresCol="x", labelCol="label", weightCol="weight", maxIter=12, maxDepth=4, stepSize=0.3, seed=SEED, cacheNodeIds=False).fit(sample)
    sample.unpersist()

    def margin(df: DataFrame) -> DataFrame:
        return trees.transform(put.transform(df)).withColumn("m", vector_to_array("rawPrediction")[1])

    one = VectorAssembler(inputCols=["m"], outputCol="mx")
    scale = LogisticRegression(featuresCol="mx", labelCol="label", regParam=0.01).fit(one.transform(margin(by_hand(CHECKED)).select("m", "label")))
    a, b = float(scale.coefficients[0]), float(scale.intercept)
    p = F.when(F.col("words") == 0, 1.0).otherwise(1 / (1 + F.exp(-(F.lit(a) * F.col("m") + F.lit(b)))))
    return margin(rows).select("doc_id", p.alias("junk_probability"), (p <= 0.5).alias("is_prose"))
