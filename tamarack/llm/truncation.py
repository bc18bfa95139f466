"""Text cut off by field limits or mid-transfer.

Two kinds of evidence, both from the whole corpus. Near-copies first: distinct texts whose min-hashes of five-word
shingles agree in a band are aligned from the start, and the copy whose alignment ends early, inside a sentence of the
other, is cut. Records without such a copy are judged by the terminality of their closing words: how often texts that go
on like this one end there. For the closing line that is the share of closing lines beginning with it that are no longer;
where few begin so, the closing two words, then one, are looked up: how often a sentence ends after them. Only texts
without closing punctuation can be cut.

Every text is parsed once; what the later steps need is written down with it. Counts are kept only for keys that some
open text asks for. A bit map sized by the number of those keys tells which they are (see keyfilter); where it is full, more keys are counted than needed, no fewer.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import Scratch
from .keyfilter import KeyFilter
from .wordhash import Words, buffers, mix, min_hashes, span_hash, span_sums

SHINGLE, SIMILARITY = 5, 0.8
BANDS, ROWS = 9, 4
#: A cut copy of fewer words has less than that similarity to any longer text.
FEWEST = 8
#: Distinct texts of a bucket that are joined in one place; of a larger bucket every block of so many meets all open texts.
BLOCK = 1024
PLACEHOLDERS = ("[deleted]", "[removed]", "[deleted by user]", "n/a", "-", "")
_ENDS, _AFTER = ".!?…", "\"')]”»*_"
_MARK = re.compile(r"(?:\s*(?:\[\s*(?:\.{3}|…)\s*\]|\(\s*(?:\.{3}|…)\s*\)|…))+$")
_BROKEN = re.compile("�+$")
_BOUNDARY = re.compile(r"[.!?…][\"')\]”»*_]*\s|\n")
_NOTE = re.compile(
    r"^(?:\s*(?:[-*•]|\d+[.)])\s|https?://|www\.|<?https?:|\s{4,})|[{};=<>]|https?://\S*$|\d[\d ()./-]{2,}$|\bdot \w+$|@\S+$"
)
_DIGITS = re.compile(r"\d+")
_K1, _K2, _KT, _KB = (np.uint64(x) for x in (0x1B873593AAAAAAA5, 0x2C1B3C6D5DEECE66, 0x3D4D51CB0D1B54A3, 0x4CF5AD432745937F))


def closing(text: str) -> tuple[str, bool, int, bool]:
    """(closing line, closed, mark, note): the text after its last sentence or line end, without marks of a cut, lower-cased,
    numbers as 0; whether it has closing punctuation; 0 no mark, 1 an ellipsis mark, 2 a broken character, 3 a comma or
    open bracket, 4 a blank at the end; whether an open text's line is a list item, link or code."""
    s = text.rstrip()
    mark = 0
    if s.endswith("�"):
        mark, s = 2, s.rstrip("�")
    elif s.endswith(("…", "]", ")")) and (m := _MARK.search(s)):
        mark, s = 1, s[: m.start()]
    elif text.endswith((" ", "\t")):
        mark = 4
    s = s.rstrip()
    if mark in (0, 4) and s.endswith((",", ";", "(")):
        mark = 3
    closed = not s or s.rstrip(_AFTER).endswith((".", "!", "?", "…"))
    if closed and s.endswith("..."):
        closed, s = False, s.rstrip(".")  # three dots close nothing by themselves
    at = max(s.rfind(". ") + 2, s.rfind("? ") + 2, s.rfind("! ") + 2, s.rfind("\n") + 1) if s else 0
    if at == 1 and s[0] != "\n":
        at = 0  # no sentence ends before it
    for m in _BOUNDARY.finditer(s, at):
        at = m.end()
    line = s[at:]
    note = not closed and bool(_NOTE.search(line))
    return " ".join(_DIGITS.sub("0", line.lower()).rstrip(".!?…\"')]”»").split()), closed, mark, note


def last_word(text: str) -> int:
    """A number above 0 for the last word; below 0 if the word stands nowhere else in the text, not even within a word; 0 for
    what is no plain word."""
    low = text.lower()
    word = low.rsplit(None, 1)[-1].strip("\"'.,;:!?…()[]*_»”’�") if low.strip() else ""
    if not word.isalpha():
        return 0
    h = zlib.crc32(word.encode()) >> 2 | 1
    return -h if low.count(word) == 1 else h


class Banded:
    """Bands of a batch of texts, and a bag of 128 bits for the shingles of each."""

    def __init__(self, texts: pa.Array) -> None:
        self.w = Words(texts)

    def bands(self) -> tuple[np.ndarray, np.ndarray]:
        sh, doc = self.w.shingles(SHINGLE)
        long = self.w.count[doc] >= FEWEST if len(doc) else np.empty(0, bool)
        sh, doc = sh[long], doc[long]
        sig, who = min_hashes(sh, doc, BANDS * ROWS)
        keys = np.zeros((BANDS, len(who)), np.uint64)
        for b in range(BANDS):
            for r in range(ROWS):
                keys[b] = mix(keys[b] * np.uint64(0x9E3779B97F4A7C15) + sig[b * ROWS + r])
            keys[b] ^= _KB + np.uint64(b)
        return keys, who

    def bags(self) -> list[np.ndarray]:
        sh, doc = self.w.shingles(SHINGLE, numbers=True)
        out = [np.zeros(self.w.n, np.uint64), np.zeros(self.w.n, np.uint64)]
        if len(sh):
            at = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
            bit = np.uint64(1) << ((sh >> np.uint64(20)) & np.uint64(63))
            high = (sh >> np.uint64(26)) & np.uint64(1) > 0
            for half, there in zip(out, (~high, high)):
                half[doc[at]] = np.bitwise_or.reduceat(np.where(there, bit, np.uint64(0)), at)
        return out


class Keys:
    """What is counted of a batch of texts: their words, pairs of words and the beginnings of their closing lines."""

    def __init__(self, texts: pa.Array, lines: pa.Array, opened: np.ndarray) -> None:
        self.open = opened
        data, off = buffers(lines)
        self.off, self.sums = off, span_sums(data)
        self.kt = span_hash(self.sums, off[:-1], off[1:]) ^ _KT
        self.w = w = Words(texts)
        prev = np.r_[np.uint64(0), w.h[:-1]] if len(w.h) else w.h
        brk = np.r_[True, w.last[:-1] | w.term[:-1]] if len(w.h) else np.empty(0, bool)
        prev = np.where(brk, np.uint64(1), prev)
        self.c1, self.c2 = w.h ^ _K1, mix(w.h * np.uint64(3) + prev * np.uint64(0x9E3779B97F4A7C15)) ^ _K2


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


_PARSED = "tab string, id long, th long, n int, words int, open boolean, mark int, note boolean, line string, kt long, k1 long, k2 long, w0 long, w1 long, end int, bands array<long>, text string"


def _parse(rows: DataFrame) -> DataFrame:
    """Every text with its closing line and state, the keys to be looked up for it, its bands and bag of shingles."""
    names = [c.split()[0] for c in _PARSED.split(", ")]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column("text")
            got = [closing(t) if t.strip().lower() not in PLACEHOLDERS else ("", True, 0, False) for t in texts.to_pylist()]
            line, closed, mark, note = (list(x) for x in zip(*got)) if got else ([], [], [], [])
            opened = ~np.array(closed, bool)
            lines = pa.array(line, pa.string())
            k = Keys(texts, pa.array(line, pa.large_string()), opened)
            x = Banded.__new__(Banded)
            x.w = w = k.w
            li = np.full(w.n, -1, np.int64)
            li[w.doc] = np.arange(len(w.h))  # the last word's place
            c1, c2 = (np.where(li >= 0, c[li] if len(c) else 0, np.uint64(0)) for c in (k.c1, k.c2))
            keys, who = x.bands()
            size = np.zeros(w.n, np.int64)
            size[who] = BANDS
            bands = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(size)].astype(np.int32)), _signed(keys.T.ravel()))
            w0, w1 = x.bags()
            ends = pa.array([last_word(t) for t in texts.to_pylist()], pa.int32())
            yield pa.RecordBatch.from_arrays(
                [b.column("tab"), b.column("id"), b.column("th"), b.column("n"), pa.array(w.count.astype(np.int32)), pa.array(opened), pa.array(mark, pa.int32()), pa.array(note, pa.bool_()),
                 lines, _signed(k.kt), _signed(c1), _signed(c2), _signed(w0), _signed(w1), ends, bands, texts], names)

    return rows.mapInArrow(scan, _PARSED)


def _counted(parsed: DataFrame, bits) -> DataFrame:
    """(key, n, e, x) for the keys asked for: times seen, with a sentence's end, at an open text's end; a row for each partition and key."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have = bits.value
        held: list[np.ndarray] = []
        counts: list[np.ndarray] = []

        def squeeze() -> None:
            inv, u = pd.factorize(np.concatenate(held))
            c = np.concatenate(counts)
            held[:], counts[:] = [u], [np.stack([np.bincount(inv, c[:, j], len(u)).astype(np.int32) for j in range(3)], 1)]

        def flush() -> pa.RecordBatch:
            squeeze()
            k, c = held.pop(), counts.pop()
            return pa.RecordBatch.from_arrays([_signed(k), *(pa.array(np.ascontiguousarray(c[:, j])) for j in range(3))], ["key", "n", "e", "x"])

        def add(keys: np.ndarray, e: np.ndarray, x: np.ndarray) -> None:
            ok = have.hits(keys)
            held.append(keys[ok])
            counts.append(np.stack([np.ones(len(held[-1]), np.int32), e[ok].astype(np.int32), x[ok].astype(np.int32)], 1))

        for b in batches:
            k = Keys(b.column("text"), b.column("line"), b.column("open").to_numpy(zero_copy_only=False))
            w = k.w
            open_end = w.last & k.open[w.doc] if len(w.h) else np.empty(0, bool)
            for keys in (k.c1, k.c2):
                add(keys, w.term & ~open_end, open_end)
            line = np.repeat(np.arange(w.n), np.diff(k.off))
            end = np.arange(1, len(line) + 1)
            full, op = end == k.off[line + 1], k.open[line]
            add(span_hash(k.sums, k.off[line], end) ^ _KT, full & ~op, full & op)
            if sum(map(len, held)) > 2_000_000:
                squeeze()
                if len(held[0]) > 1_000_000:
                    yield flush()
        if held:
            yield flush()

    return parsed.select("text", "line", "open").mapInArrow(scan, "key long, n int, e int, x int")


def _banded(parsed: DataFrame, bits) -> DataFrame:
    """(key, th, n, open, w0, w1, end) for each text and band whose key passes the filter; copies within a batch come once."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have = bits.value
        for b in batches:
            first = np.unique(b.column("th").to_numpy(zero_copy_only=False), return_index=True)[1]
            b = b.take(pa.array(np.sort(first)))
            keys = b.column("bands").flatten().to_numpy(zero_copy_only=False)
            hit = np.flatnonzero(have.hits(keys))
            at = pa.array(hit // BANDS)
            yield pa.RecordBatch.from_arrays([pa.array(keys[hit]), *(b.column(c).take(at) for c in ("th", "words", "open", "w0", "w1", "end"))], ["key", "th", "n", "open", "w0", "w1", "end"])

    return parsed.where(F.size("bands") > 0).select("th", "words", "open", "w0", "w1", "end", "bands").mapInArrow(scan, "key long, th long, n int, open boolean, w0 long, w1 long, end int")


def _may_be_near(na, nb, a0, a1, b0, b1) -> np.ndarray:
    """Whether texts of na and nb words may reach the similarity, by the bits of either bag that the other lacks: of A and B
    shingles they share 4/9 (A + B) at least, so the one lacks no more than (5 A - 4 B) / 9 of the other; one more is let pass
    for shingles that come twice."""
    s, t = na - (SHINGLE - 1), nb - (SHINGLE - 1)
    lacks = lambda x0, x1, y0, y1: np.bitwise_count(x0 & ~y0).astype(np.int32) + np.bitwise_count(x1 & ~y1)
    return (9 * (lacks(a0, a1, b0, b1) - 1) <= 5 * s - 4 * t) & (9 * (lacks(b0, b1, a0, a1) - 1) <= 5 * t - 4 * s)


def _met(rows: DataFrame) -> DataFrame:
    """rows: key, block, th, n, isa, isb, w0, w1, end, those of a key and block together, isb first. Pairs (ta, tb) of an isa and
    an isb row of one block that may be near, the second no shorter and going on: the last word of the first, if the second
    ends with it too and has it nowhere else, can't stand before its end. A block's isb rows are few (BLOCK), its isa rows any number."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] | None = None

        def pairs(x: dict[str, np.ndarray], run: np.ndarray, fresh: int) -> Iterator[pa.RecordBatch]:
            """All pairs of the runs, for the isa rows from ``fresh`` on."""
            last = np.r_[run[1:] != run[:-1], True]
            ends = np.flatnonzero(last) + 1
            starts = np.r_[0, ends[:-1]]
            many = np.add.reduceat(x["isb"].astype(np.int64), starts)
            a = np.flatnonzero(x["isa"])
            a = a[a >= fresh]
            r = run[a]
            size = many[r]
            a, r, size = a[size > 0], r[size > 0], size[size > 0]
            upto = np.cumsum(size)
            at = 0
            while at < len(a):
                to = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + 2_000_000, "right")))
                n = size[at:to]
                i = np.repeat(a[at:to], n)
                j = np.repeat(starts[r[at:to]] - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
                na, nb = x["n"][i], x["n"][j]
                ok = (nb >= na) & (4 * na >= 3 * nb)
                ends = x["end"][j]
                ok &= (ends >= 0) | (np.abs(x["end"][i]) != -ends)
                i, j, na, nb = i[ok], j[ok], na[ok], nb[ok]
                ok = _may_be_near(na, nb, x["w0"][i], x["w1"][i], x["w0"][j], x["w1"][j]) & (x["th"][i] != x["th"][j])
                yield pa.RecordBatch.from_arrays([pa.array(x["th"][i[ok]]), pa.array(x["th"][j[ok]])], ["ta", "tb"])
                at = to

        def numbered(x: dict[str, np.ndarray]) -> np.ndarray:
            new = (x["key"][1:] != x["key"][:-1]) | (x["block"][1:] != x["block"][:-1])
            return np.r_[0, np.cumsum(new)]

        for b in batches:
            if not b.num_rows:
                continue
            x = {c: b.column(c).to_numpy(zero_copy_only=False) for c in b.schema.names}
            x |= {c: x[c].view(np.uint64) for c in ("w0", "w1")}  # bits of signed numbers are counted without their sign
            fresh = 0
            if held is not None:
                fresh = held.pop("done")
                x = {c: np.concatenate([held[c], x[c]]) for c in x}
            run = numbered(x)
            end = int(np.searchsorted(run, run[-1]))  # the last run may go on
            tail = len(run) - end
            if end:
                yield from pairs({c: v[:end] for c, v in x.items()}, run[:end], fresh)
                fresh = 0
                x = {c: v[end:] for c, v in x.items()}
            if tail > 8 * BLOCK:  # a large run: its isb rows came first, what was met of the others goes
                yield from pairs(x, np.zeros(tail, np.int64), fresh)
                keep = x["isb"]
                held = {c: v[keep] for c, v in x.items()} | {"done": int(keep.sum())}
            else:
                held = x | {"done": fresh}
        if held is not None:
            fresh = held.pop("done")
            yield from pairs(held, np.zeros(len(held["th"]), np.int64), fresh)

    return rows.mapInArrow(scan, "ta long, tb long")


_TOKEN = re.compile(r"[^\W_]+(?:['’][^\W_]+)*")


class _Read:
    """A text's words; its shingles and the places of words when they are asked for."""

    def __init__(self, text: str) -> None:
        self.text, self.words, self._shingles = text, _TOKEN.findall(text.lower()), None

    def shingles(self) -> frozenset:
        if self._shingles is None:
            self._shingles = frozenset(zip(*(self.words[i:] for i in range(SHINGLE))))
        return self._shingles

    def gap(self, j: int) -> str:
        """What stands between word j and the next."""
        found = list(islice(_TOKEN.finditer(self.text.lower()), j, j + 2))
        return self.text.lower()[found[0].end() : found[1].start()]


_read = lru_cache(4096)(_Read)  # a text comes in many pairs


def ends_early(a: str, b: str) -> int:
    """Whether a, cut, is a near-copy of b up to a place inside one of b's sentences: 0 no, 1 between two words, 2 inside a word."""
    a = a.rstrip()
    if a.endswith(("�", "…", "]", ")")):
        a = _BROKEN.sub("", _MARK.sub("", a)).rstrip()
    x, y = (_read(t) if len(t) < 20_000 else _Read(t) for t in (a, b))
    wa, wb = x.words, y.words
    if len(wa) < SHINGLE or len(wb) < len(wa):
        return 0
    band = max(2, len(wa) // 10)
    last = wa[-1]
    near_end = range(max(0, len(wa) - 1 - band), min(len(wb), len(wa) + band))
    if not any(wb[j].startswith(last) and (wb[j] != last or j + 1 < len(wb)) for j in near_end):
        return 0  # the last word can't stand before the other's end
    sa, sb = x.shingles(), y.shingles()
    both = len(sa & sb)
    if both < SIMILARITY * (len(sa) + len(sb) - both):
        return 0
    row = {k: max(0, k) for k in range(0, band + 1)}  # row[k]: edits of wa[:i] against wb[:i + k]
    for i, w in enumerate(wa):
        end = i == len(wa) - 1
        new: dict[int, int] = {}
        for k in range(-min(band, i + 1), band + 1):
            j = i + k
            best = row.get(k, 99_999)
            if j < 0 or j >= len(wb):
                best = 99_999
            elif wb[j] != w and not (end and wb[j].startswith(w)):
                best += 1
            best = min(best, row.get(k + 1, 99_999) + 1, new.get(k - 1, 99_999) + 1)
            new[k] = best
        row = new
    k, edits = min(row.items(), key=lambda r: (r[1], abs(r[0])))
    j = len(wa) + k - 1  # wb[j] stands against the last word
    if edits > len(wa) // 10 or not 0 <= j < len(wb):
        return 0
    if len(wb[j]) > len(last) and wb[j].startswith(last):
        return 2
    if wb[j] != last or j + 1 >= len(wb):
        return 0
    return int(not re.search(r"[.!?…\n]", y.gap(j)))


def find_truncated(rows: DataFrame) -> DataFrame:
    """rows: tab, id, text. One row (tab, id, evidence) for each record whose text was cut inside a word, a sentence or a
    closing line; evidence is near_copy, broken_character, closing_line or closing_words.

    Null, empty and placeholder texts are never cut. A record that comes repeatedly counts once, with the text of the least
    hash where they differ. A text of fewer than FEWEST words has no near-copies. Texts are read whole; no columns but the
    three are read. No rows give no rows.
    """
    spark = rows.sparkSession
    scratch = Scratch(spark, "truncation")
    rows = rows.where("text is not null and text != '' and id is not null").select(
        F.col("tab").cast("string").alias("tab"), F.col("id").cast("long").alias("id"), F.xxhash64("text").alias("th"), F.length("text").alias("n"), F.col("text"))
    parsed = scratch.write(_parse(rows), "parsed")
    near = _near_copies(parsed, scratch)

    # terminality of the closing words for the rest, of which each distinct text is looked up once
    opened = scratch.write(parsed.where("open").groupBy("th").agg(F.count("*").alias("copies"), *[F.max(c).alias(c) for c in ("n", "words", "mark", "note", "kt", "k1", "k2")], F.max(F.length("line")).alias("line_n")), "open")
    asked = opened.select(F.explode(F.array("kt", "k1", "k2")).alias("key"))
    counts = _counted(parsed, spark.sparkContext.broadcast(KeyFilter(asked, 3 * opened.count())))
    # copies of one cut text don't vouch for each other: of longer texts each counts once
    again = opened.where((F.col("copies") > 1) & (F.col("words") >= FEWEST)).select(F.col("kt").alias("key"), (1 - F.col("copies")).cast("int").alias("n"), F.lit(0).alias("e"), (1 - F.col("copies")).cast("int").alias("x"))
    stats = counts.unionByName(again).groupBy("key").agg(*[F.sum(c).alias(c) for c in "nex"])

    look = opened.select("th", F.explode(F.array(*[F.struct(F.lit(i).alias("which"), F.col(c).alias("key")) for i, c in enumerate(("kt", "k2", "k1"))])).alias("q")).select("th", "q.which", "q.key")
    wide = look.join(stats, "key").groupBy("th").agg(*[F.max(F.when(F.col("which") == i, F.col(c))).alias(f"{c}{k}") for i, k in enumerate(("t", "2", "1")) for c in "nex"])
    limits = scratch.write(_field_limits(parsed), "limits")
    scored = opened.join(wide, "th", "left").na.fill(0).join(limits, "n", "left").join(near, "th", "left").withColumn("verdict", _verdict())
    # a copy that stops inside a word is cut; one that stops between two may lack an addition, unless texts don't end so elsewhere
    cut = F.col("in_word") | (F.col("in_word").isNotNull() & ~F.col("verdict.ends_well"))
    named = F.when(cut & (F.col("mark") != 2), "near_copy").when(~F.col("verdict.ends_well"), F.col("verdict.evidence"))
    found = scored.select("th", named.alias("evidence")).where("evidence is not null")
    return parsed.where("open").groupBy("tab", "id").agg(F.min("th").alias("th")).join(found, "th").select("tab", "id", "evidence")


def _field_limits(parsed: DataFrame) -> DataFrame:
    """(n, at_limit): lengths at which far more distinct texts end than at their neighbours, the limits of fields: five texts
    at least and thirty times the neighbours' mean. A row a length."""
    by = parsed.select("th", "n").distinct().groupBy("n").agg(F.count("*").alias("c"))
    near = by.select("n", F.col("c").alias("o"), F.explode(F.sequence(F.lit(-5), F.lit(5))).alias("d")).where("d <> 0")
    near = near.groupBy((F.col("n") + F.col("d")).alias("n")).agg(F.sum("o").alias("o"))
    return by.join(near, "n", "left").where("c >= 5 and c > 3 * coalesce(o, 0)").select("n", F.lit(True).alias("at_limit"))


def _verdict():
    """ends_well and the evidence of a cut, or null. t: closing line, 2 and 1: closing words; n seen, e with a sentence's end, x at an open text's end."""
    c = F.col
    done = c("et") + c("xt")
    whole = done / F.greatest(c("nt"), F.lit(1))
    known = c("nt") >= 8
    complete = known & ((whole >= 0.2) | ((done >= 6) & (whole >= 0.03)))
    two, one = c("n2") - c("x2"), c("n1") - c("x1")
    after2, after1 = c("e2") / F.greatest(two, F.lit(1)), c("e1") / F.greatest(one, F.lit(1))
    limit = F.coalesce(c("at_limit"), F.lit(False))
    loose = limit | (c("mark") == 1)
    words = F.when(limit, ~((two >= 5) & (after2 >= 0.5))).when(two >= 5, after2 < F.when(loose, 0.5).otherwise(0.05)).when(one >= 5, after1 < F.when(loose, 0.2).otherwise(0.02)).otherwise(c("e2") + c("e1") == 0)
    sure = (c("mark").isin(2, 3)) | ((c("mark") == 4) & limit)
    ends_well = ~sure & (complete | (~known & (two >= 5) & (after2 >= 0.2)) & ~loose)
    evidence = (
        F.when(c("mark") == 2, F.lit("broken_character"))
        .when(sure, "closing_words")
        .when(known, F.when(~complete, "closing_line"))
        .when(c("note") & ~loose, None)
        .when(c("line_n") == 0, None)
        .when(words, "closing_words")
    )
    return F.struct(ends_well.alias("ends_well"), evidence.alias("evidence"))


def _near_copies(parsed: DataFrame, scratch: Scratch) -> DataFrame:
    """(th, in_word): the open texts that a verified near-copy goes beyond, and whether some cut falls inside a word.

    All texts of a bucket that hold an open one are met with it, but for those that the bags of shingles rule out. Large
    buckets are split into blocks that each meet all open texts.
    """
    spark = parsed.sparkSession
    asked = parsed.where(F.col("open") & (F.size("bands") > 0)).select("th", "bands")
    bits = spark.sparkContext.broadcast(KeyFilter(asked.select(F.explode("bands").alias("key")), BANDS * asked.count()))
    size = _banded(parsed, bits).groupBy("key").agg(F.count("*").alias("size"), F.min("th").alias("lo"), F.max("th").alias("hi"), F.max("open").alias("any"))
    size = scratch.write(size.where("any and lo <> hi").select("key", "size"), "buckets")
    hot = scratch.write(size.where(F.col("size") > BLOCK).select("key", F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks")), "hot")
    shared = spark.sparkContext.broadcast(KeyFilter(size.select("key"), size.count()))
    own = F.struct(F.pmod(F.xxhash64("th"), F.col("blocks")).cast("int").alias("block"), F.lit(True).alias("isb"), F.lit(False).alias("isa"))
    every = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda i: F.struct(i.alias("block"), F.lit(False).alias("isb"), F.lit(True).alias("isa")))
    place = F.when(F.col("blocks").isNull(), F.array(F.struct(F.lit(0).alias("block"), F.lit(True).alias("isb"), F.col("open").alias("isa"))))
    place = place.when(F.col("open"), F.concat(F.array(own), every)).otherwise(F.array(own))
    rows = _banded(parsed, shared).join(hot, "key", "left").select("key", F.explode(place).alias("p"), "th", "n", "w0", "w1", "end").select("key", "p.*", "th", "n", "w0", "w1", "end")
    rows = rows.repartition("key", "block").dropDuplicates(["key", "block", "th", "isb"]).sortWithinPartitions("key", "block", F.col("isb").desc())
    both = scratch.write(_met(rows.select("key", "block", "th", "n", "isa", "isb", "w0", "w1", "end")).distinct(), "pairs")
    need = both.select(F.explode(F.array("ta", "tb")).alias("key")).distinct()
    wanted = spark.sparkContext.broadcast(KeyFilter(need, 2 * both.count()))

    def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            yield x.filter(pa.array(wanted.value.hits(x.column("th").to_numpy(zero_copy_only=False))))

    texts = scratch.write(parsed.select("th", "text").mapInArrow(some, "th long, text string").dropDuplicates(["th"]), "texts")

    @F.pandas_udf("int")
    def early(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([ends_early(x, y) for x, y in zip(a, b)], dtype="int32")

    ta, tb = texts.select(F.col("th").alias("ta"), F.col("text").alias("xa")), texts.select(F.col("th").alias("tb"), F.col("text").alias("xb"))
    ok = both.join(ta, "ta").join(tb, "tb").select(F.col("ta").alias("th"), early("xa", "xb").alias("early")).where("early > 0")
    return scratch.write(ok.groupBy("th").agg((F.max("early") > 1).alias("in_word")), "near")


def truncation_by_source(rows: DataFrame, cut: DataFrame, sources: DataFrame) -> DataFrame:
    """Records and cut records by tab and source. rows: tab, id, post_id; sources: post_id, source; a record counts once."""
    per = rows.select("tab", "id", "post_id").dropDuplicates(["tab", "id"]).join(cut.select("tab", "id", F.lit(1).alias("cut")), ["tab", "id"], "left").groupBy("tab", "post_id").agg(F.count("*").alias("records"), F.sum(F.coalesce("cut", F.lit(0))).alias("cut"))
    src = sources.where("post_id is not null").groupBy("post_id").agg(F.max("source").alias("source"))
    out = per.join(src, "post_id", "left").groupBy("tab", "source").agg(F.sum("records").alias("records"), F.sum("cut").alias("cut"))
    return out.withColumn("share", F.col("cut") / F.col("records"))
