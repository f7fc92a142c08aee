"""Weighted graphs of names: edges, ranks, communities, propagation.

Edges (src, dst, weight) go from the smaller to the larger name.  All loops
are joins and aggregations; each round's table is cut.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom.operators.evidence import batches
from factloom.plans.scratch import cut

#: Suffixes of propagated names, in turn.
SUFFIXES = ("_ctx", "_peer", "_handler", "_ref", "_alt")


def edge_weights(pairs: DataFrame, a: str, b: str, weight: str) -> DataFrame:
    """Pairs in either order, summed up."""
    ordered = pairs.where(F.col(a) != F.col(b)).select(F.least(a, b).alias("src"), F.greatest(a, b).alias("dst"), F.col(weight).alias("weight"))
    return ordered.groupBy("src", "dst").agg(F.sum("weight").alias("weight"))


def filter_edges(edges: DataFrame, nodes: DataFrame, node: str, least: float = 2) -> DataFrame:
    """Edges of a weight, with both ends among the nodes."""
    keep = nodes.select(F.col(node).alias("n")).distinct()
    heavy = edges.where(F.col("weight") >= least)
    return heavy.join(keep, F.col("src") == F.col("n"), "left_semi").join(keep, F.col("dst") == F.col("n"), "left_semi")


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))


def nodes_of(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()


def pagerank(edges: DataFrame, rounds: int = 20, damping: float = 0.85, every: int = 5) -> DataFrame:
    """(node, rank); nodes without out-edges pass nothing on.

    ``every``: after so many rounds the ranks are cut.
    """
    edges = cut(edges, "edges")
    nodes = cut(nodes_of(edges), "nodes")
    n = nodes.count()
    if not n:
        return nodes.withColumn("rank", F.lit(0.0))
    out = edges.groupBy("src").agg(F.sum("weight").alias("total"))
    share = cut(edges.join(out, "src").select("src", "dst", (F.col("weight") / F.col("total")).alias("share")), "shares")
    ranks = nodes.withColumn("rank", F.lit(1.0 / n))
    for k in range(1, rounds + 1):
        sent = share.join(ranks, F.col("src") == F.col("node")).groupBy("dst").agg(F.sum(F.col("rank") * F.col("share")).alias("sent"))
        ranks = nodes.join(sent, F.col("node") == F.col("dst"), "left").select("node", ((1 - damping) / n + damping * F.coalesce("sent", F.lit(0.0))).alias("rank"))
        if k % every == 0:
            ranks = cut(ranks, "ranks")
    return ranks


def label_propagation(edges: DataFrame, rounds: int = 10) -> DataFrame:
    """(node, label): every node takes the label with the most weight among its out-neighbours, ties to the smallest.

    Labels begin as the node's own name; nodes without out-edges keep it.
    All nodes change at once; it ends early when none does.
    """
    edges = cut(edges, "edges")
    labels = cut(nodes_of(edges).withColumn("label", F.col("node")), "labels")
    for _ in range(rounds):
        votes = edges.join(labels, F.col("dst") == F.col("node")).groupBy("src", "label").agg(F.sum("weight").alias("w"))
        best = votes.groupBy("src").agg(F.min(F.struct((-F.col("w")).alias("m"), "label")).alias("b")).select("src", F.col("b.label").alias("new"))
        new = labels.join(best, F.col("node") == F.col("src"), "left").select("node", F.coalesce("new", "label").alias("label"), (F.col("new") != F.col("label")).alias("moved"))
        new = cut(new, "labels")
        labels = new.select("node", "label")
        if new.where("moved").isEmpty():
            break
    return labels


def top_seeds(labels: DataFrame, ranks: DataFrame, k: int = 3) -> DataFrame:
    """The ``k`` highest nodes of each community, ties by name."""
    w = Window.partitionBy("label").orderBy(F.desc("rank"), "node")
    return labels.join(ranks, "node").withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


def independent_cascade(edges: DataFrame, seeds: DataFrame, probability: float = 0.4, steps: int = 5, seed: int = 0) -> DataFrame:
    """(node, step): nodes that the seeds reach; an edge passes with ``probability * min(weight / 3, 1)``.

    The dice are hashes of (seed, step, edge), so that a run can be repeated.
    """
    edges = cut(edges, "edges")
    active = cut(seeds.select("node").distinct().withColumn("step", F.lit(0)), "active")
    for step in range(1, steps + 1):
        front = active.where(F.col("step") == step - 1)
        dice = F.pmod(F.xxhash64(F.lit(seed), F.lit(step), "src", "dst"), F.lit(1 << 30)) / F.lit(float(1 << 30))
        passed = edges.join(front, F.col("src") == F.col("node")).where(dice < probability * F.least(F.col("weight") / 3, F.lit(1.0)))
        fresh = cut(passed.select(F.col("dst").alias("node")).distinct().join(active, "node", "left_anti").withColumn("step", F.lit(step)), "fresh")
        if fresh.isEmpty():
            break
        active = cut(active.unionByName(fresh), "active")
    return active


def propagated_names(active: DataFrame, edges: DataFrame, named: DataFrame) -> DataFrame:
    """Names for reached nodes beside a named seed: the first such seed's (by ``ordinal``) with a suffix in turn.

    ``named``: node, name, ordinal.
    """
    near = both_ways(edges).join(named.withColumnRenamed("node", "src"), "src").select(F.col("dst").alias("node"), "name", "ordinal")
    first = near.join(named.select("node"), "node", "left_anti").join(active, "node", "left_semi")
    first = first.groupBy("node").agg(F.min(F.struct("ordinal", "name"))["name"].alias("name"))
    turn = F.element_at(F.array(*map(F.lit, SUFFIXES)), (F.col("place") % len(SUFFIXES) + 1).cast("int"))
    return batches(first, ["node"], 1, "place").select("node", F.concat("name", turn).alias("name"))


def propagate_types(links: DataFrame, base: DataFrame) -> DataFrame:
    """(node, type, score): the widest path from a typed node over links, ties to the smaller type.

    ``links``: lhs, alias, score, used in both directions; ``base``: node,
    type, score.  A node takes the least of the link's and the source's score;
    it runs until nothing rises, as many rounds as the longest chain has links.
    Base nodes keep what they have.
    """
    ways = links.select(F.col("lhs").alias("dst"), F.col("alias").alias("src"), "score").unionByName(links.select(F.col("alias").alias("dst"), F.col("lhs").alias("src"), "score"))
    ways = cut(ways.withColumnRenamed("score", "link").distinct(), "links")
    fixed = base.select(F.col("node").alias("fixed"))
    known = cut(base.select("node", "type", "score"), "types")
    while True:
        sent = ways.join(known, F.col("src") == F.col("node")).select(F.col("dst").alias("node"), "type", F.least("link", "score").alias("score"))
        sent = sent.join(fixed, F.col("node") == F.col("fixed"), "left_anti")
        best = known.unionByName(sent).groupBy("node").agg(F.min(F.struct((-F.col("score")).alias("m"), "type")).alias("b"))
        new = cut(best.select("node", F.col("b.type").alias("type"), (-F.col("b.m")).alias("score")), "types")
        if new.join(known, ["node", "type", "score"], "left_anti").isEmpty():
            return new
        known = new


def cooccurrence(tokens: DataFrame, key: str, order: str, name: str, window: int = 10) -> DataFrame:
    """(a, b, n): how often two names stand within ``window - 1`` places, in both orders.

    Numbered neighbours are equi-joined, not sorted in a window, so that one
    long source is spread over many tasks.
    """
    left = tokens.select(F.col(key).alias("k"), F.col(order).alias("at"), F.col(name).alias("a"))
    ahead = left.select("k", "a", F.explode(F.sequence(F.col("at") + 1, F.col("at") + window - 1)).alias("at"))
    pairs = ahead.join(left.withColumnRenamed("a", "b"), ["k", "at"]).where("a <> b").groupBy("a", "b").agg(F.count("*").alias("n"))
    return pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "n")).groupBy("a", "b").agg(F.sum("n").alias("n"))


def connected_clusters(matrix: DataFrame, threshold: int = 5) -> DataFrame:
    """(name, cluster): names joined by any chain of pairs of at least ``threshold``, by the smallest of them.

    The scalable variant of :func:`greedy_clusters`: a name passes its smallest
    known neighbour on and jumps to what that one knows, so the rounds grow with
    the logarithm of a chain's length.
    """
    strong = cut(matrix.where((F.col("n") >= threshold) & (F.col("a") != F.col("b"))).select("a", "b").distinct(), "strong")
    ways = cut(strong.unionByName(strong.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "strong")
    labels = cut(ways.groupBy(F.col("a").alias("name")).agg(F.min(F.least("a", "b")).alias("cluster")), "clusters")
    while True:
        near = ways.join(labels, F.col("b") == F.col("name")).select(F.col("a").alias("name"), "cluster")
        best = labels.unionByName(near).groupBy("name").agg(F.min("cluster").alias("cluster"))
        # what a name's label learns, all names of that label learn
        told = best.join(labels.select("name", F.col("cluster").alias("old")), "name").groupBy("old").agg(F.min("cluster").alias("new"))
        jump = best.join(told, F.col("cluster") == F.col("old"), "left").select("name", F.least("cluster", F.coalesce("new", "cluster")).alias("cluster"))
        new = cut(jump, "clusters")
        if new.join(labels, ["name", "cluster"], "left_anti").isEmpty():
            return new
        labels = new


def greedy_clusters(matrix: DataFrame, threshold: int = 5) -> DataFrame:
    """(name, cluster): names in order take their free neighbours of at least ``threshold`` along.

    The first-come rule is a chain of decisions, so it is settled in rounds: a
    name leads once no smaller free neighbour is left undecided.
    """
    strong = cut(matrix.where((F.col("n") >= threshold) & (F.col("a") != F.col("b"))).select("a", "b").distinct(), "strong")
    free = cut(strong.select(F.col("a").alias("name")).distinct(), "free")
    done: DataFrame | None = None
    while not free.isEmpty():
        f = free.withColumnRenamed("name", "a")
        open_ = strong.join(f, "a").join(free.withColumnRenamed("name", "b"), "b")
        blocked = open_.where("b < a").select("a").distinct()
        lead = cut(f.join(blocked, "a", "left_anti"), "lead")
        # a free name goes to its smallest leading neighbour
        took = open_.join(lead, "a").where("b > a").groupBy(F.col("b").alias("name")).agg(F.min("a").alias("cluster"))
        step = cut(took.unionByName(lead.select(F.col("a").alias("name"), F.col("a").alias("cluster"))), "took")
        done = step if done is None else cut(done.unionByName(step), "clusters")
        free = cut(free.join(step, "name", "left_anti"), "free")
    if done is None:
        return free.withColumn("cluster", F.lit(None).cast("string"))
    sizes = done.groupBy("cluster").agg(F.count("*").alias("c")).where("c > 1").select("cluster")
    return done.join(sizes, "cluster").select("name", "cluster")
