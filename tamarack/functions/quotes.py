"""Finding and repairing quotes: exact search over normalised text with a map of offsets, then one unique near span."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator, Sequence
from difflib import SequenceMatcher
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..session import Scratch, partitions

_PLAIN = str.maketrans({"‘": "'", "’": "'", "“": '"', "”": '"', "–": "-", "—": "-", " ": " "})
_SPECIAL = re.compile(r"[$€£]\d[\d,.]*|\d{4}-\d{2}-\d{2}|\d+(?:[.,]\d+)*%?|\b[A-Z][a-zA-Z]+\b")
REPAIRED = "kept boolean, text string, comment_id long, attribution_fixed boolean, fuzzy boolean, numeric boolean"


@lru_cache(8192)  # a post's sources are read for each of its quotes
def normalised(text: str) -> tuple[str, list[int]]:
    """The text without emphasis marks, in small letters, white space collapsed; and each letter's place in the original."""
    out: list[str] = []
    at: list[int] = []
    for i, c in enumerate(text.translate(_PLAIN)):
        if c in "*_`":
            continue
        if c.isspace():
            if not out or out[-1] == " ":
                continue
            c = " "
        for x in c.lower():
            out.append(x)
            at.append(i)
    if out and out[-1] == " ":
        out.pop()
        at.pop()
    return "".join(out), at


_MARKS = _PLAIN | dict.fromkeys(map(ord, "*_`"))


def plain(text: str) -> str:
    """The text of normalised() without the places."""
    return " ".join(text.translate(_MARKS).split()).replace("Σ", "σ").lower()  # a capital sigma ends no word otherwise than it stands in it


def find_exact(quote: str, source: str) -> str | None:
    """The original words of the source that say the quote."""
    q = plain(quote)
    if not q or q not in plain(source):
        return None
    s, at = normalised(source)
    i = s.find(q)
    return source[at[i] : at[i + len(q) - 1] + 1]


def needed(n: int) -> float:
    """The least ratio of a span that stands for a quote of n words."""
    return 0.95 if n <= 6 else 0.92 if n <= 12 else 0.90


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _grams(codes: np.ndarray) -> np.ndarray:
    """A hash of 16 bits of every three letters. Two that share it only make a bound less tight."""
    return ((codes[:-2] * np.uint32(0x9E3779B1) + codes[1:-1] * np.uint32(0x85EBCA77) + codes[2:] * np.uint32(0xC2B2AE3D)) >> np.uint32(16)).astype(np.uint16)


class Near:
    """Spans near a normalised quote: those that may have at least a ratio, and their ratios. All that is left out is left out by
    a bound: of M letters in common, a letter of the quote that is left out takes three of its trigrams, one put in takes two."""

    def __init__(self, q: str, far: float) -> None:
        self.q, self.far, self.n = q, far, len(q.split())
        self.match = SequenceMatcher(autojunk=False)
        self.match.set_seq2(q)
        self.low, self.high = max(K.SPAN_LOW, far / (2 - far)), min(K.SPAN_HIGH, (2 - far) / far)  # lengths at which that ratio can be met
        self.grams = _grams(_codes(q))
        self.table = np.zeros(1 << 16, bool)
        self.table[self.grams] = True
        self.least = math.ceil((2.5 * far - 2) * 2 * len(q) / (2 - far) - 2 - 1e-9)  # trigrams of the quote in the shortest span
        self.width = int(self.high * len(q))
        self.bits: dict[str, int] = {}
        for i, c in enumerate(q):
            self.bits[c] = self.bits.get(c, 0) | 1 << i
        self.known: dict[str, float] = {}

    def spans(self, src: "Sources", docs: Sequence[int]) -> list[tuple[float, int, int, int]]:
        """The ratio that the longest common subsequence allows at most, text, from, to."""
        docs = np.asarray(docs, np.int64)
        if not len(docs):
            return []
        size = len(self.q)
        upto = np.cumsum(src.start[docs + 1] - src.start[docs])
        shift = src.start[docs] - np.r_[0, upto[:-1]]  # from a place in these texts alone to that in all
        place = np.arange(upto[-1], dtype=np.int32) + np.repeat(shift.astype(np.int32), src.start[docs + 1] - src.start[docs])
        hits = np.zeros(len(place) + 1, np.int32)
        np.cumsum(self.table[src.grams[place]], out=hits[1:])
        count = src.token_at[docs + 1] - src.token_at[docs]
        token = np.arange(count.sum()) + np.repeat(src.token_at[docs] - np.r_[0, np.cumsum(count)[:-1]], count)
        end, shift, doc = np.repeat(src.token_at[docs + 1], count), np.repeat(shift, count), np.repeat(docs, count)
        a = src.first[token] - shift
        ok = hits[np.minimum(a + self.width, len(hits) - 1)] - hits[a] >= self.least
        token, end, shift, doc = token[ok][:, None], end[ok][:, None], shift[ok][:, None], doc[ok]
        j = token + np.arange(max(1, int(self.n * K.SPAN_LOW)), int(self.n * K.SPAN_HIGH) + 1) - 1
        there = j < end
        long = src.last[np.minimum(j, len(src.last) - 1)] - src.first[token]
        at = src.first[token] - shift
        most = hits[np.where(there, np.maximum(at + long - 2, at), at)] - hits[at] + 2 * size + 2 * long + 2  # five times the letters in common
        ok = there & (long >= self.low * size - 1e-9) & (long <= self.high * size + 1e-9) & (2 * most >= 5 * (self.far - 1e-9) * (size + long))
        some = np.flatnonzero(ok.any(1))
        if not len(some):
            return []
        start, ok, long, doc = src.first[token[some, 0]], ok[some], long[some], doc[some]
        row, col = np.nonzero(ok)
        long = long[row, col]
        most = 2 * self.subsequence(src, start, np.where(ok.any(1), np.maximum.reduceat(long, np.searchsorted(row, np.arange(len(some)))), 0))[row, long] / (size + long)
        ok = most >= self.far - 1e-9
        row, long = row[ok], long[ok]
        at = start[row] - src.start[doc[row]]
        return list(zip(most[ok].tolist(), doc[row].tolist(), at.tolist(), (at + long).tolist()))

    def subsequence(self, src: "Sources", start: np.ndarray, long: np.ndarray) -> np.ndarray:
        """For each start, the length of the longest common subsequence of the quote and the letters up to each length."""
        size, most = len(self.q), int(long.max())
        out = np.zeros((len(start), most + 1), np.int16)
        if len(start) < 48:
            full, get = (1 << size) - 1, self.bits.get
            for r, (a, n) in enumerate(zip(start.tolist(), long.tolist())):
                v, upto = full, [0]
                for c in src.all[a : a + n]:
                    u = v & get(c, 0)
                    v = ((v + u) | (v - u)) & full
                    upto.append(size - v.bit_count())
                out[r, : n + 1] = upto
            return out
        words = (size + 63) // 64
        letters = [self.bits.get(chr(c), 0) for c in src.letters.tolist()]
        masks = np.array([[(x >> 64 * w) & (2**64 - 1) for x in letters] for w in range(words)], np.uint64)
        full = [np.uint64((((1 << size) - 1) >> 64 * w) & (2**64 - 1)) for w in range(words)]
        for lo in range(0, len(start), 8192):
            at = src.letter[np.minimum(start[lo : lo + 8192] + np.arange(most)[:, None], len(src.letter) - 1)]
            v = [np.full(at.shape[1], f) for f in full]
            for k in range(most):
                carry, n = None, 0
                for w in range(words):
                    u = v[w] & masks[w][at[k]]
                    s = v[w] + u
                    if w + 1 < words:
                        over = s < u
                    if carry is not None:
                        s += carry
                        if w + 1 < words:
                            over |= s < carry
                    if w + 1 < words:
                        carry = over.astype(np.uint64)
                    v[w] = (s | (v[w] ^ u)) & full[w]
                    n = n + np.bitwise_count(v[w]).astype(np.int16)
                out[lo : lo + 8192, k + 1] = size - n
        return out

    def ratio(self, span: str) -> float:
        if (r := self.known.get(span)) is None:
            self.match.set_seq1(span)
            r = self.known[span] = self.match.ratio()
        return r


def _best(near: Near, spans: list[tuple[float, int, int, int]], norm: list[str], margin: float) -> list[tuple[float, int, int, int]]:
    """Of spans (the ratio at most, source, from, to) those of the ratio at least and within the margin of the best, with their ratios."""
    found, floor = [], near.far
    for m, k, a, b in sorted(spans, key=lambda x: -x[0]):
        if m < floor - 1e-9:
            break
        if (r := near.ratio(norm[k][a:b])) >= near.far:
            found.append((r, k, a, b))
            floor = max(floor, r - margin)
    return found


def _unique(found: list[tuple[float, int, int, int]]) -> tuple[tuple[float, int, int, int], bool]:
    """The nearest span, and whether another that doesn't overlap it is within the margin."""
    best = max(found, key=lambda f: (f[0], -f[1], -f[2], -f[3]))
    r, k, a, b = best
    return best, any(f[0] > r - K.FUZZY_MARGIN and (f[1] != k or f[3] <= a or f[2] >= b) for f in found)


def _original(text: str, a: int, b: int) -> str:
    _, at = normalised(text)
    return text[at[a] : at[b - 1] + 1]


def find_near(quote: str, sources: list[tuple[int | None, str]]) -> tuple[int | None, str] | None:
    """The one span of the sources that is near enough and nearer than all that don't overlap it, by the margin."""
    q = plain(quote)
    n = len(q.split())
    if n < 4:
        return None
    need = needed(n)
    near = Near(q, need - K.FUZZY_MARGIN)
    src = Sources([plain(t) for _, t in sources])
    found = _best(near, near.spans(src, range(len(sources))), src.norm, K.FUZZY_MARGIN)
    if not found:
        return None
    (r, k, a, b), twice = _unique(found)
    return None if r < need or twice else (sources[k][0], _original(sources[k][1], a, b))


def repair(quote: str | None, claimed: int | None, sources: list[tuple[int | None, str]]) -> tuple:
    """(kept, text, comment_id, attribution fixed, repaired by nearness, numbers or names changed). sources: (comment id, text),
    None for the post. The claimed source goes first."""
    if not quote or not quote.strip() or not sources:
        return False, None, None, False, False, False
    order = sorted(sources, key=lambda s: s[0] != claimed)
    for cid, text in order:
        if (t := find_exact(quote, text)) is not None:
            return True, t, cid, cid != claimed, False, False
    if near := find_near(quote, order):
        cid, t = near
        return True, t, cid, cid != claimed, True, set(_SPECIAL.findall(t)) != set(_SPECIAL.findall(quote))
    return False, None, None, False, False, False


#: Letters from which on a post's texts get an index; fewer are read through for each quote.
INDEXED = 30_000


class Sources:
    """Normalised texts with an index of the places of their letters' trigrams. A quote's rarest trigrams name the few places at which
    it, or enough of it, may stand."""

    def __init__(self, norm: list[str]) -> None:
        self.norm, self.all = norm, "\n".join([*norm, "", "", ""])
        self.start = np.cumsum([0, *(len(s) + 1 for s in norm)])
        self.codes = _codes(self.all)
        self.grams = np.r_[_grams(self.codes), np.zeros(3, np.uint16)] if len(norm) else np.zeros(3, np.uint16)
        inner = (self.codes != 32) & (self.codes != 10)  # normalised: white space is one blank, and a line's end parts the texts
        self.first = np.flatnonzero(inner & np.r_[True, ~inner[:-1]])
        self.last = np.flatnonzero(inner & np.r_[~inner[1:], True]) + 1
        self.letters = np.unique(self.codes)
        self.letter = np.searchsorted(self.letters, self.codes).astype(np.uint8 if len(self.letters) < 256 else np.uint32)
        self.token_at = np.searchsorted(self.first, self.start)
        if len(self.grams) > INDEXED:
            self.at = np.r_[0, np.cumsum(np.bincount(self.grams, minlength=1 << 16))]
            self.places = np.argsort(self.grams, kind="stable").astype(np.int32)

    def doc(self, place: int) -> int:
        return int(np.searchsorted(self.start, place, "right")) - 1

    def exact(self, q: str) -> int | None:
        """The first text that holds the normalised quote."""
        if not q:
            return None
        if len(q) < 3 or len(self.grams) <= INDEXED:
            i = self.all.find(q)
            return self.doc(i) if i >= 0 else None
        g = _grams(_codes(q)).astype(np.int64)
        by = np.argsort(self.at[g + 1] - self.at[g], kind="stable")[:6]
        p = self.places[self.at[g[by[0]]] : self.at[g[by[0]] + 1]].astype(np.int64) - by[0]
        p = p[(p >= 0) & (p <= len(self.grams) - len(g))]
        for o in by[1:]:
            p = p[self.grams[p + o] == g[o]]
        return next((self.doc(i) for i in p.tolist() if self.all.startswith(q, i)), None)

    def likely(self, find: Near) -> Sequence[int]:
        """The texts with enough of the quote's trigrams within the length of a span."""
        if find.least < 1:
            return range(len(self.norm))
        if len(self.grams) <= INDEXED:
            hits = np.r_[0, np.cumsum(find.table[self.grams], dtype=np.int64)]
            upto = np.minimum(np.arange(len(hits)) + find.width, len(hits) - 1)
            some = np.flatnonzero(hits[upto] - hits >= find.least)
            return np.unique(np.searchsorted(self.start, some, "right") - 1).tolist() if len(some) else []
        g = find.grams.astype(np.int64)
        n = self.at[g + 1] - self.at[g]
        often = min(find.least, RARE)  # of any so many more than may be lost, so many are kept
        g = np.unique(g[np.argsort(n, kind="stable")[: len(g) - find.least + often]])
        shift = max(6, int(find.width).bit_length())
        p = np.concatenate([self.places[a:b] for a, b in zip(self.at[g].tolist(), self.at[g + 1].tolist())])
        bins = np.bincount(p >> shift, minlength=(len(self.grams) >> shift) + 2)
        some = np.flatnonzero(bins[:-1] + bins[1:] >= often)
        if not len(some):
            return []
        low, high = (np.searchsorted(self.start, np.minimum(x << shift, len(self.all) - 1), "right") - 1 for x in (some, some + 2))
        marks = np.bincount(low, minlength=len(self.norm) + 2) - np.bincount(np.minimum(high + 1, len(self.norm) + 1), minlength=len(self.norm) + 2)
        return np.flatnonzero(np.cumsum(marks)[: len(self.norm)])

    def near(self, q: str, least: float | None = None, only_best: bool = False) -> tuple[float, int, bool, int, int] | None:
        """The nearest span of at least that ratio (none: what its words need): its ratio, source, whether another that does not overlap
        it is within the margin, from, to. only_best: the ratio alone is right."""
        if (n := len(q.split())) < 4:
            return None
        find = Near(q, needed(n) if least is None else least)
        spans = find.spans(self, self.likely(find))
        found = _best(find, spans, self.norm, 0 if only_best else K.FUZZY_MARGIN)
        if not found:
            return None
        (r, k, a, b), twice = _unique(found)
        return r, k, twice, a, b


#: Trigrams that a place has to have of a quote's rarest, before the others are counted.
RARE = 24
#: Sources of a post that are searched at a time.
BLOCK = 32768
_SEARCHED = "post_id long, quoted_text string, missing boolean, negative long, id long, exact string, ratio double, twice boolean, near string"


def _search(asks: DataFrame, blocks: DataFrame, near: str) -> DataFrame:
    """A row for each ask (post_id, quoted_text, least) and block of its post that holds the quote or a span near it. near: best
    gives the exact finding, else the best ratio, with the nearest span where the post is one block; all gives the nearest span."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, kinds = zip(*(x.split() for x in _SEARCHED.split(", ")))
        types = [{"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_(), "double": pa.float64()}[x] for x in kinds]
        for batch in batches:
            out = []
            for i in range(batch.num_rows):
                post, one = batch["post_id"][i].as_py(), batch["blocks"][i].as_py() == 1
                cs = batch["cs"][i].values
                texts = cs.field("text").to_pylist()
                src = Sources([plain(x) for x in texts])
                get = lambda c, k: cs.field(c)[k].as_py()  # noqa: B023, E731
                for ask in batch["asks"][i].as_py():
                    quote, least = ask["quoted_text"], ask["least"]
                    q = plain(quote)
                    if near == "best":
                        if (k := src.exact(q)) is not None:
                            out.append((post, quote, get("missing", k), get("negative", k), get("id", k), find_exact(quote, texts[k]), None, None, None))
                            continue
                        if (f := src.near(q, None, True)) is None:
                            continue
                        if not one:
                            out.append((post, quote, None, None, None, None, f[0], None, None))
                            continue
                        least = f[0] - K.FUZZY_MARGIN
                    if f := src.near(q, least):
                        r, k, twice, a, b = f
                        out.append((post, quote, None, None, get("id", k), None, r, twice, _original(texts[k], a, b)))
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t) for i, t in enumerate(types)], list(names))

    per = asks.groupBy("post_id").agg(F.collect_list(F.struct("quoted_text", "least")).alias("asks"))
    n = 4 * partitions(asks.sparkSession)  # a number, so that tasks of little data and much work aren't put together
    return blocks.join(per, "post_id").repartition(n, "post_id", "block").select("post_id", "blocks", "cs", "asks").mapInArrow(scan, _SEARCHED)


def repair_quotes(pendings: DataFrame, posts: DataFrame, comments: DataFrame) -> DataFrame:
    """Each observation with its repaired quote. A post's sources are the post and all its comments: the claimed comment is read
    first, then the post, then the others, best first, in blocks of BLOCK for what is left. An unknown post or a blank quote
    is dropped (kept false)."""
    scratch = Scratch(pendings.sparkSession, "quotes")
    p = posts.select(F.col("id").alias("post_id"), F.concat_ws("\n", "title", "selftext").alias("post_text"))
    c = comments.select("post_id", F.col("id").alias("comment_id"), F.coalesce("body", F.lit("")).alias("claimed_text"))

    @F.pandas_udf(REPAIRED)
    def direct(quote: pd.Series, claimed: pd.Series, post: pd.Series, text: pd.Series) -> pd.DataFrame:
        rows = []
        for q, c, t, x in zip(quote, claimed, post, text):
            c = None if pd.isna(c) else int(c)
            at = None
            if t is not None and q and q.strip():
                src = [(None, t)] if x is None else [(c, x), (None, t)]
                at = next(((i, y) for i, s in src if (y := find_exact(q, s)) is not None), None)
            rows.append((True, at[1], at[0], at[0] != c, False, False) if at else (False, None, None, False, False, False))
        out = pd.DataFrame(rows, columns=["kept", "text", "comment_id", "attribution_fixed", "fuzzy", "numeric"])
        out["comment_id"] = out["comment_id"].astype("Int64")
        return out

    q = pendings.select("id", "post_id", "comment_id", "quoted_text").join(p, "post_id", "left").join(c, ["post_id", "comment_id"], "left")
    q = q.withColumn("r", direct("quoted_text", "comment_id", "post_text", "claimed_text")).withColumn("search", ~F.col("r.kept") & F.col("post_text").isNotNull() & (F.trim(F.coalesce("quoted_text", F.lit(""))) != ""))
    q = scratch.write(q.select("id", "post_id", F.col("comment_id").alias("claimed"), "quoted_text", "search", "r"), "direct")

    asks = q.where("search").select("post_id", "quoted_text").distinct().withColumn("least", F.lit(None).cast("double"))
    asked = asks.select("post_id").distinct()
    sources = comments.select("post_id", F.col("score").isNull().alias("missing"), (-F.coalesce("score", F.lit(0))).cast("long").alias("negative"), "id", F.coalesce("body", F.lit("")).alias("text"))
    sources = sources.unionByName(p.select("post_id", F.lit(False).alias("missing"), F.lit(None).cast("long").alias("negative"), F.lit(None).cast("long").alias("id"), F.col("post_text").alias("text")))
    sources = sources.join(asked, "post_id", "left_semi")
    size = sources.groupBy("post_id").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    blocks = sources.join(size, "post_id").groupBy("post_id", "blocks", F.pmod(F.xxhash64("id"), F.col("blocks")).alias("block")).agg(F.array_sort(F.collect_list(F.struct("missing", "negative", "id", "text"))).alias("cs"))
    blocks = scratch.write(blocks, "blocks")
    first = _search(asks, blocks, "best").groupBy("post_id", "quoted_text").agg(F.min(F.when(F.col("exact").isNotNull(), F.struct("missing", "negative", "id", "exact"))).alias("x"), F.max("ratio").alias("top"), F.max(F.when(F.col("near").isNotNull(), F.struct("ratio", "twice", "id", "near"))).alias("n"))
    first = scratch.write(first, "first")
    again = _search(first.where("x is null and n is null").select("post_id", "quoted_text", (F.col("top") - K.FUZZY_MARGIN).alias("least")), blocks, "all")
    span = again.groupBy("post_id", "quoted_text").agg(F.max(F.struct("ratio", "twice", "id", "near")).alias("n"), F.collect_list("ratio").alias("ratios"))
    span = span.where(F.size(F.filter("ratios", lambda r: r > F.col("n.ratio") - K.FUZZY_MARGIN)) == 1).select("post_id", "quoted_text", "n")
    span = span.unionByName(first.where("x is null and n is not null").select("post_id", "quoted_text", "n")).where(~F.col("n.twice"))

    @F.pandas_udf("boolean")
    def changed(near: pd.Series, quote: pd.Series) -> pd.Series:
        return pd.Series([t is not None and set(_SPECIAL.findall(t)) != set(_SPECIAL.findall(o)) for t, o in zip(near, quote)])

    got = first.drop("n").join(span, ["post_id", "quoted_text"], "left").select("post_id", "quoted_text", F.coalesce("x.exact", "n.near").alias("text"), F.coalesce("x.id", "n.id").alias("comment_id"), F.col("x").isNull().alias("fuzzy"), changed("n.near", "quoted_text").alias("numeric")).where("text is not null")
    fixed = ~F.col("s.comment_id").eqNullSafe(F.col("q.claimed"))
    found = q.alias("q").where("search").join(got.alias("s"), ["post_id", "quoted_text"], "left")
    found = found.select("q.id", F.col("s.text").isNotNull().alias("kept"), "s.text", "s.comment_id", (F.col("s.text").isNotNull() & fixed).alias("attribution_fixed"), F.coalesce("s.fuzzy", F.lit(False)).alias("fuzzy"), F.coalesce("s.numeric", F.lit(False)).alias("numeric"))
    return q.where("not search").select("id", "r.*").unionByName(found)
