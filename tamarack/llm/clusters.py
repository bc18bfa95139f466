"""Grouping records into similarity clusters: neighbour descent, then modularity communities.

A record's vector has two halves. The subject half is a sign hash of its subject words (names of products and the like);
the topic half is the mean of learned word vectors over its frequent words. Subject words are rare words, and frequent
words in whose records rare words are as good as missing: a record names one subject, so where a frequent word is the
subject no rare one stands beside it, however many records tell of it. A record that names no subject has the topic half
alone. Word vectors come from how often a word of one field meets a word of the other field of the same record (positive
pointwise mutual information, reduced by its leading eigenvectors), so different words for one thing come close. Counts
run over all records; the words of more than SHARE of the records, at most the mean number of words of a record / SHARE,
go to the driver and back, the pair counts of the MAX_WORDS commonest with them.

Neighbour descent starts from blocks of records that sort together, and improves every record's K neighbours by looking
at neighbours of neighbours, where one of the two is new, until hardly an entry changes. Communities come from local moving
by modularity gain until hardly a record moves; those whose exact centroids agree are parts of one, found by the same
descent over the centroids and joined by connected components.

Every exchange, broadcast and job of a round leaves threads and plans in the driver for a while, whatever the table's size. So
a round writes what it counts once, with the counts taken on the way, and rows that meet by one key are shuffled by it once.
"""

from __future__ import annotations

import re
import warnings
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..session import Scratch
from .components import connected_components

SHARE, MAX_WORDS, DIMS, SIGNS = 0.003, 3000, 64, 64
#: A frequent word names a subject if rare words stand beside it less than this often, as a share of what is usual.
BESIDE = 0.5
K, CHUNK, ROUNDS, MOVES = 10, 1024, 20, 40
#: Descent ends when a round changes less than this share of all neighbour entries, local moving when less than this share of
#: the records move in two rounds; ROUNDS and MOVES end what does not settle, with a warning that says how much still changed.
SETTLED = 0.002
#: Least cosine of linked records; of the centroids of communities that are one, if each is the other's nearest; and without that.
LINK, SAME, SURE = 0.88, 0.9, 0.96
_WORD = re.compile(r"[^\W_]+(?:['’-][^\W_]+)*")


def _words(t: str | None) -> list[str]:
    return _WORD.findall(t.lower()) if t else []


def _vocabulary(rows: DataFrame) -> tuple[dict[str, int], np.ndarray, frozenset]:
    """The commonest words with their places, their inverse record frequencies, and frequent words beyond them, which are no topic
    words and no subjects."""
    n = rows.count()
    words = F.array_distinct(F.regexp_extract_all(F.lower(F.concat_ws(" ", "a", "b")), F.lit(r"([\p{L}\p{N}]+(?:['’-][\p{L}\p{N}]+)*)"), 1))
    df = rows.select(F.explode(words).alias("w")).groupBy("w").agg(F.count("*").alias("n")).where(F.col("n") > max(8.0, SHARE * n))
    got = df.orderBy(F.col("n").desc(), "w").collect()  # at most the mean number of words / SHARE
    top = got[:MAX_WORDS]
    return {r.w: i for i, r in enumerate(top)}, np.array([np.log(n / r.n) for r in top]), frozenset(r.w for r in got[MAX_WORDS:])


def word_vectors(rows: DataFrame, vocabulary: dict[str, int], middle: frozenset = frozenset()) -> tuple[np.ndarray, np.ndarray]:
    """A unit vector of DIMS for each word of the vocabulary, from the pairs (word of a, word of b) of all records; and
    which words are general: those beside which rare words stand about as often as beside others."""
    v = len(vocabulary)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = np.zeros((v + 1, v + 2), np.int32)  # the last row is all records; column v: records, v + 1: with a rare word
        spelling = Spelling(vocabulary)
        for b in batches:
            for x, y in zip(b.column("a").to_pylist(), b.column("b").to_pylist()):
                wx, wy = _words(x), _words(y)
                rare = any(w not in vocabulary and w not in middle and not w.isdigit() and spelling.fix(w) not in vocabulary for w in wx + wy)
                i, j = ([vocabulary[w] for w in set(t) if w in vocabulary] for t in (wx, wy))
                if i and j:
                    m[np.ix_(i, j)] += 1
                here = [*set(i + j), v]
                m[here, v] += 1
                m[here, v + 1] += rare
        i, j = np.nonzero(m)
        yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(m[i, j].astype(np.int64))], ["i", "j", "n"])

    m = np.zeros((v + 1, v + 2))
    pairs = rows.select("a", "b").mapInArrow(count, "i int, j int, n long").groupBy("i", "j").agg(F.sum("n").alias("n"))
    for r in pairs.toLocalIterator():  # at most MAX_WORDS^2 rows, a partition at a time
        m[r.i, r.j] = r.n
    with np.errstate(divide="ignore", invalid="ignore"):
        beside = np.nan_to_num(m[:, v + 1] / m[:, v])
    general = beside[:v] >= BESIDE * beside[v]
    m = m[:v, :v]
    m += m.T
    m = m * np.outer(general, general)
    s = m.sum(1, keepdims=True)
    with np.errstate(divide="ignore", invalid="ignore"):
        p = np.where(m > 0, np.log(m * m.sum() / np.maximum(s * s.T, 1e-12)), 0.0)
    p = np.maximum(p - 0.3, 0)
    val, vec = np.linalg.eigh(p)
    top = np.argsort(-np.abs(val))[: min(DIMS, max(4, v // 3))]  # fewer than words, or different words never come close
    e = vec[:, top] * np.sqrt(np.abs(val[top]))
    if e.shape[1] < DIMS:
        e = np.pad(e, ((0, 0), (0, DIMS - e.shape[1])))
    return (e / np.maximum(np.linalg.norm(e, axis=1, keepdims=True), 1e-9)).astype(np.float32), general


class Spelling:
    """Words that are one slip (a letter too few, too many, wrong or swapped) away from a word of the vocabulary."""

    def __init__(self, vocabulary: dict[str, int]) -> None:
        self.near: dict[str, str] = {}
        for w in vocabulary:
            if len(w) >= 4 and w.isalpha():
                for d in {w, *self._less(w)}:
                    self.near.setdefault(d, w)
        self.seen: dict[str, str] = {}

    @staticmethod
    def _less(w: str) -> list[str]:
        return [w[:i] + w[i + 1 :] for i in range(len(w))]

    def fix(self, w: str) -> str:
        if w not in self.seen:
            if len(self.seen) > 200_000:
                self.seen.clear()
            self.seen[w] = next((self.near[d] for d in (w, *self._less(w)) if d in self.near and abs(len(self.near[d]) - len(w)) <= 1), w) if len(w) >= 4 and w.isalpha() else w
        return self.seen[w]


def _signs(word: str) -> np.ndarray:
    import hashlib

    bits = np.unpackbits(np.frombuffer(hashlib.blake2b(word.encode(), digest_size=SIGNS // 8).digest(), np.uint8))
    return bits.astype(np.float32) * 2 - 1


def vectorise(rows: DataFrame, vocabulary: dict[str, int], idf: np.ndarray, vectors: np.ndarray, middle: frozenset = frozenset()) -> DataFrame:
    """(id, subject, place, vec) of the records that have a topic word: vec is SIGNS + DIMS bytes, both halves of equal norm, the
    first all zeros without a subject; subject is the subject word said most often, or empty; place orders the records of one
    subject."""
    spark = rows.sparkSession
    held = spark.sparkContext.broadcast((vocabulary, idf, vectors))
    line = np.random.default_rng(5).standard_normal(DIMS).astype(np.float32)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voc, weight, e = held.value
        spelling = Spelling(voc)
        for b in batches:
            ids, subjects, places, vecs = [], [], [], []
            for i, x, y in zip(*(b.column(c).to_pylist() for c in ("id", "a", "b"))):
                wx, wy = ([w if w in voc else spelling.fix(w) for w in _words(t)] for t in (x, y))
                rare: dict[str, int] = {}
                for w in wx + wy:
                    if w not in voc and w not in middle and not w.isdigit():
                        rare[w] = rare.get(w, 0) + 1
                k = [voc[w] for w in set(wx + wy) if w in voc]
                if not k:
                    continue
                s = sum((n * n * _signs(w) for w, n in rare.items()), np.zeros(SIGNS, np.float32))
                t = (e[k] * (weight[k] ** 1.5)[:, None]).sum(0)
                if not np.abs(t).max():
                    continue
                s, t = s / max(np.linalg.norm(s), 1e-9), t / np.linalg.norm(t)
                ids.append(i)
                subjects.append(min(rare, key=lambda w: (-rare[w], w)) if rare else "")
                places.append(float(t @ line))
                vecs.append(np.rint(np.r_[s, t] * 127).clip(-127, 127).astype(np.int8).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(subjects, pa.string()), pa.array(places, pa.float64()), pa.array(vecs, pa.binary())], ["id", "subject", "place", "vec"])

    return rows.mapInArrow(scan, "id long, subject string, place double, vec binary")


def _matrix(col: pa.Array) -> np.ndarray:
    m = np.frombuffer(b"".join(col.to_pylist()), np.int8).reshape(len(col), -1).astype(np.float32)
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-9)


def _top(sim: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the k largest in each row, the diagonal left out."""
    np.fill_diagonal(sim, -1)
    k = min(k, sim.shape[1] - 1)
    if k < 1:
        return np.empty(0, int), np.empty(0, int)
    j = np.argpartition(-sim, k - 1, axis=1)[:, :k]
    return np.repeat(np.arange(len(sim)), k), j.ravel()


def _edges(u, v, s) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64()), pa.array(np.asarray(s, np.float32))], ["u", "v", "sim"])


def _block_neighbours(nodes: DataFrame, order: list, shift: int, least: float) -> DataFrame:
    """The K nearest of every record among the CHUNK that sort with it. Range partitions split a subject of any size."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        n, first = 0, True

        def emit(rows: pa.Table) -> pa.RecordBatch:
            ids, m = rows.column("id").to_numpy(), _matrix(rows.column("vec").combine_chunks())
            sim = m @ m.T
            i, j = _top(sim, K)
            s = sim[i, j]
            ok = s >= least
            return _edges(ids[i[ok]], ids[j[ok]], s[ok])

        for b in batches:
            held.append(b)
            n += b.num_rows
            while n >= (want := CHUNK - shift if first else CHUNK):
                rows = pa.Table.from_batches(held)
                yield emit(rows.slice(0, want).combine_chunks())
                held, n, first = rows.slice(want).to_batches(), n - want, False
        if n > 1:
            yield emit(pa.Table.from_batches(held).combine_chunks())

    return nodes.repartitionByRange(*order).sortWithinPartitions(*order).select("id", "vec").mapInArrow(scan, "u long, v long, sim float")


def _counted(df: DataFrame, scratch: Scratch, name: str, **sums: Column) -> tuple[DataFrame, dict]:
    """df written, and sums over its rows that were taken while it was."""
    seen = Observation()
    return scratch.write(df.observe(seen, *(c.alias(k) for k, c in sums.items())), name), seen.get


def _best(edges: DataFrame) -> DataFrame:
    """edges: u, v, sim, new. The K nearest of every u, r the place of each; an entry held before isn't new."""
    w = Window.partitionBy("u").orderBy(F.col("sim").desc(), "v")
    one = edges.groupBy("u", "v").agg(F.max("sim").alias("sim"), F.min("new").alias("new"))
    return one.withColumn("r", F.row_number().over(w)).where(F.col("r") <= K)


def _descend(edges: DataFrame, nodes: DataFrame, turn: int, least: float) -> DataFrame:
    """Better neighbours found among neighbours of neighbours: K forward and K reverse ones of every record meet, where one of two
    is new. A record's reverse ones are drawn anew each round; a hub's are thinned on every task before they come together, as
    Spark does for the first K of a window (WindowGroupLimit)."""
    low = edges.where(F.col("r") == K).select(F.col("u").alias("v"), F.col("sim").alias("low"))  # of full lists
    draw = F.xxhash64("u", "v", F.lit(turn))
    back = edges.select(F.col("v").alias("u"), F.col("u").alias("v"), "new").withColumn("draw", draw)
    back = back.withColumn("r", F.row_number().over(Window.partitionBy("u").orderBy("draw", "v"))).where(F.col("r") <= K)
    meet = edges.select("u", "v", "new").unionByName(back.select("u", "v", "new")).repartition("u").groupBy("u", "v").agg(F.max("new").alias("new"))
    meet = meet.withColumn("any", F.max("new").over(Window.partitionBy("u"))).where("any").drop("any")  # 2 K rows of a u at most
    meet = meet.join(nodes.select(F.col("id").alias("v"), "vec"), "v").join(low, "v", "left")
    meet = meet.repartition("u").sortWithinPartitions("u").select("u", "v", "vec", F.coalesce("low", F.lit(least)).cast("float").alias("low"), "new")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left: pa.Table | None = None

        def emit(t: pa.Table) -> pa.RecordBatch:
            u, v, low_ = (t.column(c).to_numpy() for c in ("u", "v", "low"))
            new = t.column("new").to_numpy()
            m = _matrix(t.column("vec").combine_chunks())
            cut = np.flatnonzero(np.r_[True, u[1:] != u[:-1], True])
            a, b, s = [], [], []
            for x, y in zip(cut[:-1], cut[1:]):
                if y - x < 2:
                    continue
                sim = m[x:y] @ m[x:y].T
                fresh = new[x:y]
                sim[~(fresh[:, None] | fresh[None, :])] = -1
                np.fill_diagonal(sim, -1)
                i, j = np.nonzero((sim > low_[x:y, None]) & (sim >= least))
                a.append(v[x + i])
                b.append(v[x + j])
                s.append(sim[i, j])
            return _edges(*(np.concatenate(z) if z else np.empty(0) for z in (a, b, s)))

        for batch in batches:
            t = pa.Table.from_batches([batch]) if left is None else pa.concat_tables([left, pa.Table.from_batches([batch])])
            u = t.column("u").to_numpy()
            end = int(np.searchsorted(u, u[-1])) if len(u) else 0  # the last record's rows may go on
            if len(u) and np.all(u[:-1] <= u[1:]) and end:
                yield emit(t.slice(0, end).combine_chunks())
                left = t.slice(end)
            else:
                left = t
        if left is not None and left.num_rows:
            yield emit(left.combine_chunks())

    return meet.mapInArrow(scan, "u long, v long, sim float")


def neighbour_graph(nodes: DataFrame, scratch: Scratch, least: float = 0.6) -> DataFrame:
    """(u, v, sim): up to K nearest neighbours of every node of at least that cosine."""
    start = _block_neighbours(nodes, ["subject", "place", "id"], 0, least).unionByName(_block_neighbours(nodes, ["subject", "id"], CHUNK // 2, least)).unionByName(_block_neighbours(nodes, ["place", "id"], 0, least))
    edges = scratch.write(_best(start.withColumn("new", F.lit(True))), "edges")
    for turn in range(ROUNDS):
        found = _descend(edges, nodes, turn, least).withColumn("new", F.lit(True))
        old = edges
        edges, s = _counted(_best(edges.drop("r").withColumn("new", F.lit(False)).unionByName(found)), scratch, "edges", n=F.count(F.lit(1)), new=F.count_if("new"))
        scratch.drop(old)
        if s["new"] <= SETTLED * s["n"]:
            return edges.drop("new", "r")
    warnings.warn(f"{s['new']} of {s['n']} neighbour entries still changed in round {ROUNDS}", RuntimeWarning, stacklevel=2)
    return edges.drop("new", "r")


def communities(edges: DataFrame, scratch: Scratch, moves: int = MOVES) -> DataFrame:
    """(id, c): local moving. edges: u, v, w in both directions. In each round half of the nodes, by hash, move to the
    neighbouring community of the greatest modularity gain (ties: the least number), until hardly one moves. After the first
    two rounds only nodes are looked at whose neighbours have moved since."""
    start = edges.groupBy("u").agg(F.sum("w").alias("k")).select(F.col("u").alias("id"), F.col("u").alias("c"), "k", F.lit(True).alias("on"))
    lab, s = _counted(start, scratch, "lab", total=F.sum("k"), n=F.count(F.lit(1)))
    n, total = s["n"], s["total"] or 1.0
    if not n:
        return lab.select("id", "c")
    last = n
    for turn in range(moves):
        half = F.pmod(F.xxhash64("id", F.lit(turn // 2)) + turn, F.lit(2)) == 0  # either half in turn
        own = lab.where(F.col("on") & half).select(F.col("id").alias("u"), F.col("c").alias("mine"), "k")
        near = edges.join(own, "u").join(lab.select(F.col("id").alias("v"), "c"), "v").select("u", "c", "mine", "k", "w")
        all_ = near.unionByName(own.select("u", F.col("mine").alias("c"), "mine", "k", F.lit(0.0).alias("w"))).repartition("u").groupBy("u", "c", "mine").agg(F.max("k").alias("k"), F.sum("w").alias("w"))
        volume = lab.groupBy("c").agg(F.sum("k").alias("vol"))
        gain = F.col("w") - F.col("k") * (F.col("vol") - F.when(F.col("c") == F.col("mine"), F.col("k")).otherwise(0.0)) / F.lit(total)
        best = all_.join(volume, "c").groupBy("u", "mine").agg(F.max(F.struct(F.round(gain, 9).alias("g"), (-F.col("c")).alias("n"))).alias("b"))
        moved, s = _counted(best.select(F.col("u").alias("id"), (-F.col("b.n")).alias("to")).where(F.col("to") != F.col("mine")), scratch, "moved", n=F.count(F.lit(1)))
        # still to look at: what was left to the other half, and the neighbours of what moved
        next_to = edges.join(moved.select(F.col("id").alias("v")), "v", "left_semi").select(F.col("u").alias("id"), F.lit(None).cast("long").alias("to"), F.lit(True).alias("stirred"))
        news = moved.withColumn("stirred", F.lit(False)).unionByName(next_to).groupBy("id").agg(F.max("to").alias("to"), F.max("stirred").alias("stirred"))
        old, lab = lab, scratch.write(lab.join(news, "id", "left").select("id", F.coalesce("to", "c").alias("c"), "k", (F.coalesce("stirred", F.lit(False)) | (F.col("on") & ~half)).alias("on")), "lab")
        scratch.drop(old)
        scratch.drop(moved)
        if turn % 2 and last + s["n"] <= SETTLED * n:  # both halves of a draw
            return lab.select("id", "c")
        last = s["n"]
    warnings.warn(f"{last} of {n} records still moved in round {moves}", RuntimeWarning, stacklevel=2)
    return lab.select("id", "c")


def modularity(edges: DataFrame, lab: DataFrame) -> float:
    """Of a labelling (id, c) of the graph (u, v, w in both directions)."""
    total = edges.agg(F.sum("w")).first()[0] or 1.0
    a, b = lab.select(F.col("id").alias("u"), F.col("c").alias("cu")), lab.select(F.col("id").alias("v"), F.col("c").alias("cv"))
    inside = edges.join(a, "u").join(b, "v").where("cu = cv").agg(F.coalesce(F.sum("w"), F.lit(0.0))).first()[0]
    volume = edges.join(a, "u").groupBy("cu").agg(F.sum("w").alias("w")).agg(F.coalesce(F.sum(F.col("w") * F.col("w")), F.lit(0.0))).first()[0]
    return inside / total - volume / total**2


def cluster(df: DataFrame, id_col: str = "id", first: str = "title", second: str = "description") -> tuple[DataFrame, DataFrame]:
    """Members (id, cluster_id) of the clusters of two or more records, cluster_id the least id, and the graph's edges (u, v,
    w) between class representatives. Records whose two texts are alike word for word are one class from the start.

    A null text has no words; a record that names no subject meets others that name none, by its topic; one without a frequent
    word stays alone unless it has copies. Of rows that repeat an id one counts. An empty table gives no rows; other columns are ignored.
    """
    spark = df.sparkSession
    scratch = Scratch(spark, "clusters")
    norm = lambda c: F.trim(F.regexp_replace(F.lower(F.coalesce(F.col(c).cast("string"), F.lit(""))), r"[^\p{L}\p{N}'’-]+", " "))
    rows = df.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), norm(first).alias("a"), norm(second).alias("b")).groupBy("id").agg(F.min(F.struct("a", "b")).alias("t")).select("id", "t.a", "t.b").where("a != '' or b != ''")
    rows = scratch.write(rows, "rows")
    copies = scratch.write(rows.groupBy("a", "b").agg(F.min("id").alias("rep"), F.count("*").alias("n")), "classes")
    reps = copies.select(F.col("rep").alias("id"), "a", "b")
    member = rows.join(copies, ["a", "b"]).select("id", "rep")
    none = spark.createDataFrame([], "id long, cluster_id long"), spark.createDataFrame([], "u long, v long, w double")
    vocabulary, idf, middle = _vocabulary(rows)
    if not vocabulary:
        return member.join(member.groupBy("rep").agg(F.count("*").alias("n")).where("n > 1"), "rep").select("id", F.col("rep").alias("cluster_id")), none[1]
    vectors, general = word_vectors(rows, vocabulary, middle)
    keep = {w: j for j, w in enumerate(w for w, i in vocabulary.items() if general[i])}
    nodes = scratch.write(vectorise(reps, keep, idf[general], vectors[general], middle), "nodes")
    graph = neighbour_graph(nodes, scratch).where(F.col("sim") >= LINK)
    both = graph.select("u", "v", "sim").unionByName(graph.select(F.col("v").alias("u"), F.col("u").alias("v"), "sim")).groupBy("u", "v").agg(F.max("sim").cast("double").alias("w"))
    both = scratch.write(both.withColumn("w", F.pow((F.col("w") - LINK) / (1 - LINK) + 0.05, 2)), "graph")
    lab = communities(both, scratch)

    # parts of one cluster: communities whose exact centroids agree
    def centre(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = np.array(b.column("sums").to_pylist(), np.float32)
            s = s.reshape(b.num_rows, -1)
            for half in (slice(0, SIGNS), slice(SIGNS, None)):
                s[:, half] /= np.maximum(np.linalg.norm(s[:, half], axis=1, keepdims=True), 1e-9)
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("subject"), b.column("place"), pa.array([np.rint(x * 127).astype(np.int8).tobytes() for x in s], pa.binary())], ["id", "subject", "place", "vec"])

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sums by community within a batch, so that a large one is summed in parts."""
        for b in batches:
            c = b.column("c").to_numpy()
            m = _matrix(b.column("vec"))
            ids, inv = np.unique(c, return_inverse=True)
            s = np.zeros((len(ids), m.shape[1]), np.float32)
            np.add.at(s, inv, m)
            one = np.zeros(len(ids), int)
            one[inv] = np.arange(len(c))
            yield pa.RecordBatch.from_arrays([pa.array(ids), b.column("subject").take(pa.array(one)), b.column("place").take(pa.array(one)), pa.array(s.tolist(), pa.list_(pa.float32()))], ["id", "subject", "place", "sums"])

    parts = lab.join(nodes, "id").select("c", "subject", "place", "vec").mapInArrow(spread, "id long, subject string, place double, sums array<float>")
    sums = parts.groupBy("id").agg(F.mode("subject").alias("subject"), F.avg("place").alias("place"), F.array(*[F.sum(F.col("sums")[i]) for i in range(SIGNS + DIMS)]).alias("sums"))
    centres = scratch.write(sums.mapInArrow(centre, "id long, subject string, place double, vec binary"), "centres")
    near = neighbour_graph(centres, scratch, SAME)
    first = near.groupBy("u").agg(F.max_by("v", F.struct("sim", -F.col("v"))).alias("v"))
    mutual = first.join(first.select(F.col("v").alias("u"), F.col("u").alias("v")), ["u", "v"])  # no chains of centroids ever further apart
    near = near.where(F.col("sim") >= SURE).select("u", "v").unionByName(mutual)
    joined = connected_components(near, "u", "v", "centres")
    lab = lab.join(joined.select(F.col("id").alias("c"), "group_id"), "c", "left").select(F.col("id").alias("rep"), F.coalesce("group_id", "c").alias("c"))
    whole = member.join(lab, "rep", "left").select("id", F.coalesce("c", "rep").alias("c"))
    named = whole.groupBy("c").agg(F.min("id").alias("cluster_id"), F.count("*").alias("n")).where("n > 1")
    return scratch.write(whole.join(named, "c").select("id", "cluster_id"), "members"), both


def describe(members: DataFrame, edges: DataFrame, df: DataFrame, typical: int = 3, id_col: str = "id", title: str = "title") -> DataFrame:
    """(cluster_id, size, typical_ids, typical_titles): the members of the highest weighted degree inside the cluster, ties by id."""
    a = members.select(F.col("id").alias("u"), "cluster_id")
    b = members.select(F.col("id").alias("v"), F.col("cluster_id").alias("other"))
    degree = edges.join(a, "u").join(b, "v").where("cluster_id = other").groupBy("u").agg(F.sum("w").alias("degree"))
    rank = Window.partitionBy("cluster_id").orderBy(F.coalesce("degree", F.lit(0.0)).desc(), "u")
    best = a.join(degree, "u", "left").withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= typical)
    named = best.join(df.groupBy(F.col(id_col).alias("u")).agg(F.min(title).alias("title")), "u")
    top = named.groupBy("cluster_id").agg(F.array_sort(F.collect_list(F.struct("rank", "u", "title"))).alias("t"))
    size = members.groupBy("cluster_id").agg(F.count("*").alias("size"))
    return size.join(top, "cluster_id").select("cluster_id", "size", F.col("t.u").cast("array<string>").alias("ids"), F.col("t.title").alias("titles")).select("cluster_id", "size", F.array_join("ids", ",").alias("typical_ids"), F.array_join("titles", " | ").alias("typical_titles"))
