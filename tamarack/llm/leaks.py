"""Evaluation texts leaking into training text: q-gram lemma filtering and banded alignment.

Texts are compared as their words (runs of letters and digits, lower-cased) joined by one blank. A passage of L
characters within e edits of another shares at least L + 1 - q(e + 1) of its q-grams with it, all on diagonals at most
e apart. So shared q-grams are counted in overlapping bands of diagonals; the windows of L characters that meet the
bound stay, and around every run of q-grams there the texts are aligned within the band, as far as the edits go to both sides.

The corpus is scanned once, however many items there are: a bit map of all items' q-grams is sent to that scan, which
keeps the documents with a window of L + e characters that holds enough of them. Only these suspects meet the items, in
blocks of at most BLOCK_CHARS characters. q follows the length of an item's own passages, so items of short words don't
blunt the search for the others.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import Scratch, partitions
from .keyfilter import KeyFilter
from .wordhash import buffers, span_hash, span_sums

WORDS = 12
EDITS = 2
BLOCK_CHARS = 2_000_000
#: Lengths of q-grams; an item takes the longest that its passages allow.
QS = (4, 6, 8, 12, 16, 24)
_WORD = re.compile(r"[^\W_]+")
_SCHEMA = "doc_id long, item_id long, shared_qgrams int, doc_from int, item_from int, edits int, shared_run boolean"


def words_of(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def qgrams(data: bytes, q: int) -> np.ndarray:
    """A 64-bit hash of every q bytes in a row."""
    a = np.frombuffer(data, np.uint8).astype(np.uint64)
    if len(a) < q:
        return np.empty(0, np.uint64)
    n = len(a) - q + 1
    h = np.zeros(n, np.uint64)
    for i in range(q):
        h = h * np.uint64(0x9E3779B97F4A7C15) + a[i : i + n]
    return h ^ (h >> np.uint64(29))


def gram_keys(data: bytes, q: int) -> np.ndarray:
    """The q-grams of one text as Suspects hashes them."""
    n = len(data) - q + 1
    s = np.arange(max(0, n))
    return span_hash(span_sums(np.frombuffer(data, np.uint8)), s, s + q)


def _same(x: bytes, i: int, y: bytes, j: int) -> int:
    """How many bytes are equal from x[i] and y[j] on."""
    n = min(len(x) - i, len(y) - j)
    if n <= 0 or x[i : i + n] == y[j : j + n]:
        return max(n, 0)
    lo = 0
    while n - lo > 1:
        mid = (lo + n) // 2
        if x[i + lo : i + mid] == y[j + lo : j + mid]:
            lo = mid
        else:
            n = mid
    return lo


def reach(x: bytes, y: bytes, edits: int) -> list[tuple[int, int]]:
    """For 0, 1, ... edits the most bytes of x, and then of y, that a common beginning of both takes in: the alignment in a band of as
    many diagonals to each side, kept as the furthest place on every diagonal."""
    at = {0: _same(x, 0, y, 0)}
    out = [(at[0], at[0])]
    for k in range(1, edits + 1):
        new = {}
        for d in range(-k, k + 1):  # y is d bytes further than x
            i = max(at.get(d, -2) + 1, at.get(d - 1, -2), at.get(d + 1, -2) + 1)
            i = min(i, len(x), len(y) - d)
            if i >= 0 and i + d >= 0:
                new[d] = i + _same(x, i, y, i + d)
        at = new
        best = max(((i, i + d) for d, i in at.items()), default=out[-1])
        out.append(max(best, out[-1]))
    return out


def aligned(item: bytes, i: int, doc: bytes, j: int, least: int, edits: int) -> tuple[int, int, int] | None:
    """(edits, start in the document, start in the item) of a passage of at least that many bytes around equal bytes at i and j,
    with the fewest edits; None if it takes more edits."""
    right = reach(item[i : i + least], doc[j : j + least + edits], edits)
    left = reach(item[max(0, i - least) : i][::-1], doc[max(0, j - least - edits) : j][::-1], edits)
    for k in range(edits + 1):
        for n in range(k + 1):
            if left[n][0] + right[k - n][0] >= least:
                return k, j - left[n][1], i - left[n][0]
    return None


def passages(text: str | None, words: int, edits: int) -> tuple[bytes, int, int] | None:
    """The words of an item, the least length of so many of them in a row, and the q that this length allows; None for fewer words."""
    w = words_of(text)
    if len(w) < words:
        return None
    ends = np.cumsum([len(x.encode()) + 1 for x in w])
    least = int((ends[words - 1 :] - np.r_[0, ends[: len(w) - words]]).min()) - 1
    return " ".join(w).encode(), least, max((q for q in QS if q <= least // (edits + 1)), default=QS[0])


def bound(least: int, q: int, edits: int) -> int:
    """The lemma: q-grams that a passage of so many characters shares with any within so many edits."""
    return max(1, least + 1 - q * (edits + 1))


class Items:
    """The q-gram index of one block of items of one q."""

    def __init__(self, rows: list[tuple[int, str]], words: int, edits: int, q: int | None = None) -> None:
        self.words, self.edits = words, edits
        toks = [(i, w) for i, t in rows if len(w := words_of(t)) >= words]
        self.ids = [i for i, _ in toks]
        self.text = [" ".join(w).encode() for _, w in toks]
        spans = [[" ".join(w[k : k + words]) for k in range(len(w) - words + 1)] for _, w in toks]
        self.runs = [frozenset(s) for s in spans]
        self.least = min((len(x.encode()) for s in spans for x in s), default=2 * words - 1)
        self.q = q or max((x for x in QS if x <= self.least // (edits + 1)), default=QS[0])
        self.bound = bound(self.least, self.q, edits)
        edge = bytes(self.least)
        self.flat = np.frombuffer(edge + edge.join(self.text) + edge, np.uint8)
        self.base = np.cumsum([self.least, *(len(t) + self.least for t in self.text)])[:-1]
        grams = [qgrams(t, self.q) for t in self.text]
        flat = np.concatenate(grams) if grams else np.empty(0, np.uint64)
        order = np.argsort(flat, kind="stable")
        self.hash = flat[order]
        self.item = np.repeat(np.arange(len(grams), dtype=np.int32), [len(g) for g in grams])[order] if grams else np.empty(0, np.int32)
        self.pos = (np.concatenate([np.arange(len(g), dtype=np.int32) for g in grams]) if grams else np.empty(0, np.int32))[order]

    def _may_align(self, item: np.ndarray, i: np.ndarray, doc: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Which seeds (equal bytes at i of an item and j of the document) may lie in a passage within the edits: but for that many
        bytes of it, each one of the item's bytes equals the document's on some diagonal of the band."""
        n, wide = self.least, np.arange(-self.least, self.least)
        out = np.empty(len(item), bool)
        for s in range(0, len(item), 2048):
            at = slice(s, s + 2048)
            x = self.flat[self.base[item[at]][:, None] + i[at][:, None] + wide]
            y = j[at][:, None] + wide + (n + self.edits)  # the document has that many bytes in front
            same = np.zeros(x.shape, bool)
            for d in range(-self.edits, self.edits + 1):
                same |= x == doc[y + d]
            off = np.zeros((len(x), 2 * n + 1), np.int16)
            np.cumsum(~same, axis=1, out=off[:, 1:])
            out[at] = (off[:, n:] - off[:, : n + 1]).min(axis=1) <= self.edits
        return out

    def match(self, text: str | None) -> list[tuple]:
        """(item index, shared q-grams, start in the document, start in the item, edits, shares a run of words) of every item with a passage in the text."""
        toks = words_of(text)
        if len(toks) < self.words or not len(self.hash):
            return []
        doc = " ".join(toks).encode()
        h = qgrams(doc, self.q)
        lo, hi = np.searchsorted(self.hash, h, "left"), np.searchsorted(self.hash, h, "right")
        n = hi - lo
        at = np.flatnonzero(n)
        if not len(at):
            return []
        n = n[at]
        dpos = np.repeat(at, n)
        k = np.repeat(lo[at] - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
        item, ipos = self.item[k], self.pos[k].astype(np.int64)
        wide = 2 * self.edits + 1
        band = (dpos - ipos) // wide
        item, ipos, dpos, band = np.r_[item, item], np.r_[ipos, ipos], np.r_[dpos, dpos], np.r_[band, band + 1]  # bands overlap by half
        order = np.lexsort((ipos, band, item))
        item, ipos, dpos, band = item[order], ipos[order], dpos[order], band[order]
        new = np.r_[True, (item[1:] != item[:-1]) | (band[1:] != band[:-1])]
        group = np.cumsum(new) - 1
        place = (group << 32) + ipos
        count = np.searchsorted(place, place + self.least - self.q, "right") - np.arange(len(place))
        most = np.maximum.reduceat(count, np.flatnonzero(new))
        good = most[group] >= self.bound
        item, ipos, dpos, most = item[good], ipos[good], dpos[good], most[group[good]]
        # the first gram of every run of grams that go on along one diagonal
        order = np.lexsort((-most, ipos, dpos - ipos, item))
        item, ipos, dpos, most = item[order], ipos[order], dpos[order], most[order]
        first = np.r_[True, (item[1:] != item[:-1]) | ((dpos - ipos)[1:] != (dpos - ipos)[:-1]) | (ipos[1:] > ipos[:-1] + 1)] if len(item) else np.empty(0, bool)
        item, ipos, dpos, most = item[first], ipos[first], dpos[first], most[first]
        pad = np.ones(self.least + self.edits, np.uint8)
        may = self._may_align(item, ipos, np.concatenate([pad, np.frombuffer(doc, np.uint8), pad]), dpos)
        best: dict[int, tuple] = {}
        runs: set[str] | None = None
        for i, a, d, m in zip(*(x[may].tolist() for x in (item, ipos, dpos, most))):
            if (old := best.get(i)) and old[4] == 0:
                continue
            if runs is None:
                runs = {" ".join(toks[x : x + self.words]) for x in range(len(toks) - self.words + 1)}
            got = aligned(self.text[i], a, doc, d, self.least, self.edits)
            if got and (not old or got[0] < old[4]):
                best[i] = (i, m, got[1], got[2], got[0], old[5] if old else not runs.isdisjoint(self.runs[i]))
        return list(best.values())


def _joined(texts: pa.Array) -> pa.Array:
    """The words of each text, lower-cased and joined by one blank, as words_of gives them."""
    return pc.utf8_trim(pc.replace_substring_regex(pc.utf8_lower(texts), r"[^\pL\pN]+", " "), " ")


class Suspects:
    """Which texts of a batch may hold a passage: those with a window that holds enough of the items' q-grams."""

    def __init__(self, kinds: list[tuple[int, int, int, KeyFilter]]) -> None:
        self.kinds = kinds  # q, window, least number of grams, filter

    def among(self, texts: pa.Array) -> np.ndarray:
        data, off = buffers(texts)
        out = np.zeros(len(texts), bool)
        sums = span_sums(data)
        for q, window, least, have in self.kinds:
            n = len(data) - q + 1
            if n <= 0:
                continue
            s = np.arange(n)
            hit = have.hits(span_hash(sums, s, s + q))
            doc = np.repeat(np.arange(len(texts)), np.diff(off))[:n]
            hit &= s + q <= off[doc + 1]
            at = np.flatnonzero(hit)
            if len(at) < least:
                continue
            # the place of the least-th hit from here on, if it is in this text and within the window
            to = at[least - 1 :]
            near = (to - at[: len(to)] <= window) & (doc[to] == doc[at[: len(to)]])
            out[doc[at[: len(to)][near]]] = True
        return out


def find_leaks(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text", words: int = WORDS, edits: int = EDITS, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """One row for each document and item that share a passage of about ``words`` words within ``edits`` edits; shared_run
    tells whether they share that many consecutive words exactly.

    Null and empty texts, and texts of fewer words, match nothing; repeated rows come out repeatedly; no items or no
    documents give no rows; other columns are ignored. Texts are read whole.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "leaks")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [(i, t, p[1], p[2], np.unique(gram_keys(p[0], p[2])).view(np.int64)) for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) if (p := passages(t, words, edits))]
            cols = list(zip(*got)) if got else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.list_(pa.int64())))], ["i", "t", "least", "q", "grams"])

    one = items.select(F.col(item_id).cast("long").alias("i"), F.col(text).cast("string").alias("t")).where("i is not null and t is not null").distinct()
    one = scratch.write(one.mapInArrow(read, "i long, t string, least int, q int, grams array<long>"), "items")
    kinds = one.groupBy("q").agg(F.min("least").alias("least"), F.sum(F.size("grams")).alias("n"), F.sum(F.length("t")).alias("chars")).orderBy("q").collect()  # a row a q
    if not kinds:
        return spark.createDataFrame([], _SCHEMA)
    filters = [(k.q, k.least + edits, bound(k.least, k.q, edits), KeyFilter(one.where(F.col("q") == k.q).select(F.explode("grams").alias("key")), k.n, 64, True)) for k in kinds]
    held = spark.sparkContext.broadcast(Suspects(filters))  # at most 64 MB for each of the six q

    def sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(held.value.among(_joined(b.column(1)))))

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).where("doc_id is not null and text is not null")
    suspects = scratch.write(rows.mapInArrow(sift, "doc_id long, text string"), "suspects")
    out = []
    for k in kinds:
        blocks = max(1, -(-k.chars // block_chars))
        mine = one.where(F.col("q") == k.q).select("i", "t", F.pmod(F.xxhash64("i"), F.lit(blocks)).alias("block"))
        for n in range(blocks):
            got = [(r.i, r.t) for r in mine.where(F.col("block") == n).collect()]  # about block_chars characters
            if not got:
                continue
            index = spark.sparkContext.broadcast(Items(got, words, edits, k.q))

            def scan(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
                ix = index.value
                for b in batches:
                    got = [(d, ix.ids[m[0]], *m[1:]) for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for m in ix.match(t)]
                    cols = list(zip(*got)) if got else [[]] * 7
                    types = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.bool_())
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], ["doc_id", "item_id", "shared_qgrams", "doc_from", "item_from", "edits", "shared_run"])

            out.append(suspects.repartition(partitions(spark)).mapInArrow(scan, _SCHEMA))
    return reduce(DataFrame.unionByName, out)
