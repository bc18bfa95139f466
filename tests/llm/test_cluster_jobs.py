import random
import warnings

from tamarack.llm import clusters
from tamarack.session import Scratch


def _jobs(spark, group, run):
    sc = spark.sparkContext
    sc.setJobGroup(group, group)
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")  # of rounds that end before they settle
            run()
    finally:
        sc._jsc.clearJobGroup()
    return len(sc.statusTracker().getJobIdsForGroup(group))


def test_a_round_starts_few_jobs(spark):
    """What a round leaves in the driver goes with its jobs, whatever the size of the graph."""
    rnd = random.Random(2)
    pairs = {(g * 20 + a, g * 20 + b) for g in range(12) for a, b in (rnd.sample(range(20), 2) for _ in range(60))}
    pairs |= {(rnd.randrange(240), rnd.randrange(240)) for _ in range(200)}
    both = spark.createDataFrame([(*x, 1.0) for u, v in pairs if u != v for x in ((u, v), (v, u))], "u long, v long, w double").groupBy("u", "v").agg({"w": "max"}).toDF("u", "v", "w")
    scratch = Scratch(spark, "t")
    both = scratch.write(both, "graph")
    one, two = (_jobs(spark, f"moves-{n}", lambda n=n: clusters.communities(both, scratch, moves=n)) for n in (1, 2))
    assert two - one <= 11, (one, two)


def test_a_round_of_descent_starts_few_jobs(spark):
    rnd = random.Random(4)
    nodes = spark.createDataFrame([(i, f"s{i % 7}", rnd.random(), bytearray(rnd.randrange(256) for _ in range(128))) for i in range(300)], "id long, subject string, place double, vec binary")
    scratch = Scratch(spark, "t")
    nodes = scratch.write(nodes, "nodes")
    old, clusters.SETTLED, rounds = clusters.SETTLED, -1, clusters.ROUNDS  # never settled
    got = []
    try:
        for n in (1, 2):
            clusters.ROUNDS = n
            got.append(_jobs(spark, f"rounds-{n}", lambda: clusters.neighbour_graph(nodes, scratch, -0.9)))
    finally:
        clusters.SETTLED, clusters.ROUNDS = old, rounds
    assert got[1] - got[0] <= 8, got


def test_a_graph_without_links_has_no_communities(spark):
    none = spark.createDataFrame([], "u long, v long, w double")
    assert clusters.communities(none, Scratch(spark, "t")).count() == 0
    nodes = spark.createDataFrame([(1, "a", 0.1, bytearray(b"\x01" * 128))], "id long, subject string, place double, vec binary")
    assert clusters.neighbour_graph(nodes, Scratch(spark, "t")).count() == 0
