"""Graphs as the pattern of a matrix: edges (src, dst)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tilefold.functions.staging import saved
from tilefold.operators import matrix as M


def of_matrix(a: DataFrame) -> DataFrame:
    """Undirected edges, src < dst, once each."""
    return a.where("i <> j").select(F.least("i", "j").alias("src"), F.greatest("i", "j").alias("dst")).distinct()


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()


def degrees(edges: DataFrame) -> DataFrame:
    return both_ways(edges).groupBy(F.col("src").alias("node")).agg(F.count("*").alias("degree"))


def triangles(edges: DataFrame) -> DataFrame:
    """(node, triangles). Edges run from the node of lower degree, so no node starts more than sqrt(2 E) of them and hubs
    do not pair all their neighbours."""
    d = degrees(edges)
    e = edges.join(d.select(F.col("node").alias("src"), F.col("degree").alias("ds")), "src").join(d.select(F.col("node").alias("dst"), F.col("degree").alias("dd")), "dst")
    up = F.struct(F.col("ds"), F.col("src")) < F.struct(F.col("dd"), F.col("dst"))
    e = e.select(F.when(up, F.col("src")).otherwise(F.col("dst")).alias("lo"), F.when(up, F.col("dst")).otherwise(F.col("src")).alias("hi"))
    ordered = e.withColumn("k", F.row_number().over(Window.partitionBy("lo").orderBy("hi")))
    wedges = ordered.alias("x").join(ordered.alias("y"), (F.col("x.lo") == F.col("y.lo")) & (F.col("x.k") < F.col("y.k"))).select(F.col("x.lo").alias("a"), F.col("x.hi").alias("b"), F.col("y.hi").alias("c"))
    closed = wedges.withColumns({"src": F.least("b", "c"), "dst": F.greatest("b", "c")}).join(edges, ["src", "dst"], "left_semi")
    return closed.select(F.explode(F.array("a", "b", "c")).alias("node")).groupBy("node").agg(F.count("*").alias("triangles"))


def _saved(df: DataFrame) -> DataFrame:
    return saved(df, "graph")


def levels(edges: DataFrame, start: int) -> DataFrame:
    """(node, level): steps from a node, breadth first; a round a level."""
    spark, out = edges.sparkSession, _saved(both_ways(edges))
    front, level = _saved(spark.createDataFrame([(start, 0)], "node bigint, level int")), 0
    seen = front  # the fronts so far, each written once
    while True:
        level += 1
        reached = out.join(front.select(F.col("node").alias("src")), "src", "left_semi").select(F.col("dst").alias("node")).distinct()
        front = _saved(reached.join(seen, "node", "left_anti").select("node", F.lit(level).alias("level")))
        if front.isEmpty():
            return seen
        seen = seen.unionByName(front)


def colouring(edges: DataFrame) -> DataFrame:
    """(node, colour): adjacent nodes differ. In each round the nodes that precede all their uncoloured neighbours, by
    degree and then by hash, take the least colour that no neighbour has."""
    out = _saved(both_ways(edges))
    d = out.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("degree"))
    rank = F.struct(-F.col("degree"), F.xxhash64("node"), F.col("node"))
    nodes = _saved(d.select("node", rank.alias("rank"), F.lit(None).cast("int").alias("colour")))
    while not nodes.where("colour is null").isEmpty():
        other = nodes.select(F.col("node").alias("dst"), F.col("rank").alias("r"), F.col("colour").alias("c"))
        about = out.join(other, "dst").groupBy(F.col("src").alias("node")).agg(F.min(F.when(F.col("c").isNull(), F.col("r"))).alias("first"), F.array_sort(F.collect_set("c")).alias("taken"))
        free = F.array_min(F.array_except(F.sequence(F.lit(0), F.size("taken")), F.col("taken")))
        turn = F.col("colour").isNull() & (F.col("first").isNull() | (F.col("rank") < F.col("first")))
        nodes = _saved(nodes.join(about, "node").select("node", "rank", F.when(turn, free).otherwise(F.col("colour")).cast("int").alias("colour")))
    return nodes.select("node", "colour")


def coarsen(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """Edges between the classes (node, label) of an undirected graph, once each; those within a class go."""
    named = edges.join(labels.select(F.col("node").alias("src"), F.col("label").alias("a")), "src").join(labels.select(F.col("node").alias("dst"), F.col("label").alias("b")), "dst")
    return named.where("a <> b").select(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst")).distinct()


def independent_set(edges: DataFrame, distance: int = 2) -> DataFrame:
    """Nodes of a maximal set in which any two are more than `distance` steps apart.

    In each round a node enters whose rank (hash, then id) is the least of all open nodes in reach, and what it reaches
    is closed. Ranks travel step by step, one row a node, so the pairs of a hub's neighbours are never made.
    """
    links = _saved(both_ways(edges))
    # the hash takes whole numbers of 64 bits one to one, and single numbers need no sort to find the least
    rank = F.xxhash64("node") if dict(links.dtypes)["src"] == "bigint" else F.struct(F.xxhash64("node").alias("h"), "node")
    nodes = _saved(links.select(F.col("src").alias("node")).distinct().select("node", rank.alias("r")))
    chosen = None

    def nearest(values: DataFrame) -> DataFrame:
        """(node, r): the least of a node's own value and those of the nodes in reach. The last of several steps goes against the links,
        since those that are left start from open nodes."""
        for k in range(distance):
            a, b = ("dst", "src") if 0 < k == distance - 1 else ("src", "dst")
            sent = links.join(values.select(F.col("node").alias(a), "r"), a).select(F.col(b).alias("node"), "r")
            values = values.unionByName(sent).groupBy("node").agg(F.min("r").alias("r"))
        return values

    while not nodes.isEmpty():
        least = nearest(nodes).withColumnRenamed("r", "least")
        entered = _saved(nodes.join(least, "node").where(F.col("r") == F.col("least")).select("node"))
        reached = nearest(entered.select("node", F.lit(1).alias("r"))).select("node")
        nodes = saved(nodes.join(reached, "node", "left_anti"), "graph", instead_of=nodes)
        if distance <= 2:  # no way of two steps between open nodes has a link between closed ones
            links = saved(links.join(nodes.select(F.col("node").alias("src")), "src", "left_semi"), "graph", instead_of=links)
        chosen = entered if chosen is None else chosen.unionByName(entered)
    return nodes.select("node") if chosen is None else chosen


def conflicts(edges: DataFrame, colours: DataFrame) -> DataFrame:
    """One row: edges between nodes of one colour, and coloured nodes."""
    named = edges.join(colours.select(F.col("node").alias("src"), F.col("colour").alias("a")), "src").join(colours.select(F.col("node").alias("dst"), F.col("colour").alias("b")), "dst")
    bad = named.where("a = b").agg(F.count("*").alias("conflicts")).select("conflicts", F.lit(0).cast("bigint").alias("nodes"))
    own = colours.where("colour is not null").agg(F.count_distinct("node").alias("nodes")).select(F.lit(0).cast("bigint").alias("conflicts"), "nodes")
    return bad.unionByName(own).agg(F.sum("conflicts").alias("conflicts"), F.sum("nodes").alias("nodes"))


def within_two(edges: DataFrame) -> DataFrame:
    """Edges between nodes at one or two steps: what a colouring at distance two has to tell apart. Their number follows
    the pairs of neighbours of each node, so this is for graphs without hubs."""
    out = both_ways(edges)
    two = out.join(out.select(F.col("src").alias("dst"), F.col("dst").alias("far")), "dst").where("src < far").select("src", F.col("far").alias("dst"))
    return edges.select("src", "dst").unionByName(two).distinct()


def bandwidth_order(edges: DataFrame, start: int) -> DataFrame:
    """(node, place): breadth-first levels from a node, within a level by degree and id, turned round, so that neighbours
    stand near each other; nodes that are not reached come first, by id."""
    edges = _saved(edges)
    known = degrees(edges).join(levels(edges, start), "node", "left")
    deepest = known.agg(F.coalesce(F.max("level"), F.lit(-1))).scalar()
    turned = known.select("node", F.coalesce(deepest - F.col("level") + 1, F.lit(0)).cast("bigint").alias("turn"), F.when(F.col("level").isNull(), 0).otherwise(-F.col("degree")).alias("by"))
    return M.ranked(turned, "turn", "by", F.col("node").desc()).select("node", F.col("rank").alias("place"))


def _roots(parents: DataFrame) -> DataFrame:
    """(node, root) from (node, parent), where following the parents ends at two nodes that point at each other, the lesser
    of which is the root, or at a node that points at itself. Each round doubles how far a node looks."""
    of = parents.select(F.col("node").alias("parent"), F.col("parent").alias("over"))
    mutual = (F.col("over") == F.col("node")) & (F.col("node") < F.col("parent"))
    now = _saved(parents.join(of, "parent").select("node", F.when(mutual, F.col("node")).otherwise(F.col("parent")).alias("root")))
    while True:
        above = now.select(F.col("node").alias("root"), F.col("root").alias("over"))
        after = saved(now.join(above, "root").select("node", F.col("over").alias("root"), (F.col("over") != F.col("root")).alias("moved")), "graph", instead_of=now)
        if after.where("moved").isEmpty():
            return after.select("node", "root")
        now = after.select("node", "root")


def spanning_forest(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The minimum spanning forest (src, dst, w, round) of weighted edges (src, dst, w), and its tree of segments (round,
    segment, parent): what each segment of a round is merged into.

    In each round every segment takes its least outgoing edge, by weight and then by ends, what is so joined becomes one
    segment, and of parallel edges the least stays; so rounds are at most the logarithm of the nodes. Least edges are
    found with a partial aggregation, so a segment with very many edges is no hot key.
    """
    e = edges.where("src <> dst").select(F.least("src", "dst").alias("u"), F.greatest("src", "dst").alias("v"), F.struct("w", F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).alias("e"))
    e = _saved(e.groupBy("u", "v").agg(F.min("e").alias("e")))
    forest = e.select("e.src", "e.dst", "e.w", F.lit(0).alias("round")).limit(0)
    tree = e.select(F.lit(0).alias("round"), F.col("u").alias("segment"), F.col("v").alias("parent")).limit(0)
    k = 0
    while not e.isEmpty():
        sides = e.select(F.col("u").alias("node"), F.struct("e", F.col("v").alias("to")).alias("m")).unionByName(e.select(F.col("v").alias("node"), F.struct("e", F.col("u").alias("to")).alias("m")))
        best = _saved(sides.groupBy("node").agg(F.min("m").alias("m")))
        taken = best.select("m.e.src", "m.e.dst", "m.e.w").distinct().withColumn("round", F.lit(k))
        roots = _roots(best.select("node", F.col("m.to").alias("parent")))
        forest = forest.unionByName(taken)
        tree = tree.unionByName(roots.select(F.lit(k).alias("round"), F.col("node").alias("segment"), F.col("root").alias("parent")))
        named = e.join(roots.select(F.col("node").alias("u"), F.col("root").alias("a")), "u").join(roots.select(F.col("node").alias("v"), F.col("root").alias("b")), "v").where("a <> b")
        e = saved(named.groupBy(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).agg(F.min("e").alias("e")), "graph", instead_of=e)
        k += 1
    return forest, tree


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of all nodes with an edge to another, a component being named by one of its nodes."""
    _, tree = spanning_forest(edges.select("src", "dst", F.lit(0).alias("w")))
    rounds = (tree.agg(F.max("round")).first()[0] if not tree.isEmpty() else None) or 0
    out = tree.where("round = 0").select(F.col("segment").alias("node"), F.col("parent").alias("component"))
    for k in range(1, rounds + 1):
        above = tree.where(F.col("round") == k).select(F.col("segment").alias("component"), F.col("parent").alias("over"))
        out = out.join(above, "component", "left").select("node", F.coalesce("over", "component").alias("component"))
    return out
