"""Batched graph searches: every operator takes a table of queries and an edge table and returns a table.

Edges have src, relation, dst, score, ord. All cuts have a total order, so results do not depend
on how the tables are partitioned.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evigraph.sources.workspace import HELD, dealt, folder  # noqa: F401 (HELD is read from here)

#: Node keys (about 100 bytes each in memory), and paths, that are sent to all tasks; more are merged.
FEW, FEW_PATHS = 500_000, 20_000
#: Bits of the filter of node keys that is sent to all tasks where the keys are not few; its size does not grow with them.
KEY_BITS = 1 << 25
#: Parts into which a node's neighbours are dealt before each part is cut.
SPREAD = 4
#: Score of a path by its number of nodes; longer paths have the last one.
PATH_SCORES = {1: 1.0, 2: 0.90, 3: 0.82, 4: 0.74, 5: 0.66}
LONG_PATH_SCORE = 0.58
MAX_PATH_NODES = 12


def edge_text(head: str, relation: str, tail: str) -> Column:
    return F.concat(F.col(head), F.lit(" --"), F.col(relation), F.lit("--> "), F.col(tail))


def relation_search(edges: DataFrame, pairs: DataFrame, include_reverse: bool = True, directed: bool = True, max_results: int = 20) -> DataFrame:
    """Edges between the two ends of every pair (query_id, source, target).

    Forward edges come first, then reverse ones; equal (head, relation, tail, direction) count
    once. With directed=False, pairs without any result are tried as undirected.
    """
    e = edges.select("src", "relation", "dst", "score", "ord")

    def between(a: str, b: str, direction: str, place: int) -> DataFrame:
        return (
            pairs.filter("source <> '' and target <> ''")
            .join(e, (F.col(a) == F.col("src")) & (F.col(b) == F.col("dst")))
            .select("query_id", "source", "target", F.col("src").alias("head"), "relation", F.col("dst").alias("tail"), F.lit(direction).alias("direction"), F.lit(place).alias("place"), "score", "ord")
        )

    found = between("source", "target", "forward", 0)
    if include_reverse:
        found = found.unionByName(between("target", "source", "reverse", 1))
    if not directed:
        rest = between("target", "source", "undirected", 2).join(found.select("query_id").distinct(), "query_id", "left_anti")
        found = found.unionByName(rest.withColumns({"head": F.col("source"), "tail": F.col("target")}))
    once = Window.partitionBy("query_id", "head", "relation", "tail", "direction").orderBy("ord", F.desc("score"))
    cut = Window.partitionBy("query_id").orderBy("place", "relation", "head", "tail")
    out = found.withColumn("_r", F.row_number().over(once)).filter("_r = 1").withColumn("_r", F.row_number().over(cut)).filter(F.col("_r") <= max_results)
    return out.select("query_id", "head", "relation", "tail", "direction", "score", edge_text("head", "relation", "tail").alias("text"))


def neighbor_search(edges: DataFrame, seeds: DataFrame, direction: str = "both", max_neighbors: int = 20, include_relation: bool = True, outs: DataFrame | None = None) -> DataFrame:
    """Neighbours of every seed (query_id, entity); an unknown direction means both.

    Few entities get numbers, so that what is dealt and grouped has neither their names nor the queries'; the first
    max_neighbors of each entity, among which are the first of each query, then meet the queries. With more than FEW,
    edges are joined to the seeds. outs, if given, holds all edges out of the entities.
    """
    direction = direction if direction in ("in", "out") else "both"
    rows = seeds.limit(FEW + 1).count()
    few = rows <= FEW
    if few:
        who, rows = settle(seeds.select("entity").filter("entity is not null").distinct().withColumn("_id", F.monotonically_increasing_id()), "numbered")
        keys, own = who.select(F.col("entity").alias("node")), ["_id"]
    else:
        who, own = seeds, ["query_id", "entity"]
    parts = []
    for way, at, other, place in (("out", "src", "dst", 0), ("in", "dst", "src", 1)):
        if direction in (way, "both"):
            e = (outs if way == "out" and outs is not None else edges).select("src", F.col("relation") if include_relation else F.lit("related_to").alias("relation"), "dst", "score", "ord")
            found = (within(e, at, keys, rows) if few else e).join(F.broadcast(who) if few else who, F.col("entity") == F.col(at))
            parts.append(found.select(*own, "relation", F.col(other).alias("neighbor"), F.lit(place).alias("place"), "score", F.coalesce("ord", F.lit(-(2**31))).alias("ord")))
    found = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    # the first parallel edge gives the score, of equal ones an unknown score, else the highest; all by sums of numbers, which take no sorting
    found = found.withColumn("_part", F.pmod(F.xxhash64("neighbor"), F.lit(SPREAD)))
    found = dealt(found, own[0], "_part")
    edge = [*own, "_part", "relation", "neighbor", "place"]
    score = F.when(~F.max(F.col("score").isNull()), -F.min(-F.col("score"))).alias("score")
    once = found.groupBy(*edge, "ord").agg(score).groupBy(*edge).agg(F.min_by("score", "ord").alias("score"))
    out_going = F.col("place") == 0
    if few:  # an entity's edges in the order below
        best = Window.partitionBy("_id").orderBy(F.desc("score"), "place", F.when(~out_going, F.col("neighbor")), "relation", "neighbor")
        once = once.withColumn("_r", F.row_number().over(best)).filter(F.col("_r") <= max_neighbors).join(F.broadcast(who), "_id").join(F.broadcast(seeds.select("query_id", "entity").distinct()), "entity")
    once = once.select("query_id", "entity", F.when(out_going, F.col("entity")).otherwise(F.col("neighbor")).alias("src"), "relation", F.when(out_going, F.col("neighbor")).otherwise(F.col("entity")).alias("dst"), "neighbor", F.when(out_going, "out").otherwise("in").alias("direction"), "place", "score")
    cut = Window.partitionBy("query_id").orderBy(F.desc("score"), "place", "src", "relation", "dst")
    out = once.withColumn("rank", F.row_number().over(cut)).filter(F.col("rank") <= max_neighbors)
    return out.select("query_id", "entity", F.col("src").alias("source"), "relation", F.col("dst").alias("target"), "neighbor", "direction", "score", edge_text("src", "relation", "dst").alias("text"), "rank")


def adjacency(edges: DataFrame, directed: bool = True) -> DataFrame:
    """Distinct (node, next)."""
    out = edges.select(F.col("src").alias("node"), F.col("dst").alias("next"))
    if not directed:
        out = out.unionByName(edges.select(F.col("dst").alias("node"), F.col("src").alias("next")))
    return out.distinct()


def settle(df: DataFrame, tag: str) -> tuple[DataFrame, int]:
    """df written to a folder of the run and read back, with its number of rows."""
    spark = df.sparkSession
    where = folder(spark, tag)
    df.write.parquet(where)
    out = spark.read.schema(df.schema).parquet(where)
    return out, out.count()


def hinted(df: DataFrame, rows: int, few: int = FEW) -> DataFrame:
    """df for the right side of a join: sent to all tasks if it has few rows, else merged."""
    return F.broadcast(df) if rows <= few else df.hint("merge")


def maybe_within(edges: DataFrame, end: str, nodes: DataFrame, rows: int) -> DataFrame:
    """Edges one end of which is among nodes (node); of more than FEW nodes a filter is sent to all tasks, which lets some others pass, so a join must follow."""
    if rows <= FEW:
        return within(edges, end, nodes, rows)
    place = lambda key: F.pmod(F.xxhash64(key), F.lit(KEY_BITS)).cast("int")
    bits = nodes.select(place("node").alias("_p")).groupBy(F.shiftright("_p", 6).alias("_w")).agg(F.expr("bit_or(shiftleft(1L, _p % 64))").alias("_v"))
    marked = edges.withColumn("_p", place(end)).withColumn("_w", F.shiftright("_p", 6)).join(F.broadcast(bits), "_w")
    return marked.filter("shiftright(_v, _p % 64) & 1L = 1").select(edges.columns)


def within(edges: DataFrame, end: str, nodes: DataFrame, rows: int) -> DataFrame:
    """Edges one end of which is among nodes (node), of which there are so many rows; Spark filters them before it groups or joins them."""
    return edges.join(hinted(nodes.select(F.col("node").alias("_node")), rows), F.col(end) == F.col("_node"), "left_semi")


def _suffixes(edges: DataFrame, pairs: DataFrame, hops: int, directed: bool, outs: DataFrame | None) -> DataFrame:
    """node, target, path: all simple paths of 1 to hops hops that can belong to a pair (source, target) with other ends.

    Sets of nodes grow from the sources and paths from the targets, each time on the side that has fewer rows, until
    they are one hop apart. Paths then grow on from node to node through the sources' sets alone, so hubs that
    lead elsewhere are followed on neither side, and no pair is carried along. outs, if given, holds all edges out of
    the sources, which are then not looked for among the others.
    """
    ends = edges.select(F.col("src").alias("node"), F.col("dst").alias("next"))
    if not directed:
        ends = ends.unionByName(ends.select(F.col("next").alias("node"), F.col("node").alias("next")))
    sources = [settle(pairs.select(F.col("source").alias("node")).distinct(), "sources")]
    near = None if outs is None or not directed else outs.select(F.col("src").alias("node"), F.col("dst").alias("next"))
    zero = pairs.select(F.col("target").alias("node"), "target", F.array("target").alias("path")).distinct()
    tails, rows = settle(zero, "targets")
    zero = tails

    kept = {}

    def grown(tails: DataFrame, rows: int, place: int) -> DataFrame:
        step = kept.get(place, near if place == 0 and near is not None else ends)
        if place in kept:
            pass
        elif place < len(sources) and (place or sources[0][1] < rows):
            step = within(step, "node", *sources[place])
        elif place < len(sources):  # the pairs are joined at the end
            step = maybe_within(step, "node", *sources[place])
        if rows <= FEW_PATHS:  # only what is joined is made distinct
            step = within(step, "next", tails.select("node").distinct(), rows).distinct()
        else:  # dealt by next once, for both
            step = dealt(maybe_within(step, "next", tails.select("node"), rows), "next").distinct()
        longer = step.join(hinted(tails.withColumnRenamed("node", "next"), rows, FEW_PATHS), "next").filter(~F.array_contains("path", F.col("node")))
        return longer.select("node", "target", F.concat(F.array("node"), "path").alias("path"))

    def headed() -> tuple[DataFrame, int]:
        nodes, n = sources[-1]
        first = len(sources) == 1 and near is not None
        step = within(near if first else ends, "node", nodes, n)
        if not first and n <= FEW_PATHS:  # edges out of few nodes are kept, so that paths grow along them without reading all edges again
            step, _ = settle(step.distinct(), "steps")
            kept[len(sources) - 1] = step
        return settle(step.select(F.col("next").alias("node")).distinct(), "heads")

    place = hops
    if near is not None and place > 1:
        sources.append(headed())
    while place > len(sources):
        if rows < sources[-1][1]:
            place -= 1
            tails, rows = settle(zero.unionByName(grown(tails, rows, place)), "tails")
        else:
            sources.append(headed())
    while place > 1:
        place -= 1
        tails, rows = settle(zero.unionByName(grown(tails, rows, place)), "tails")
    return grown(tails, rows, 0)


def path_search(edges: DataFrame, pairs: DataFrame, max_nodes: int = 4, max_paths: int = 5, directed: bool = True, outs: DataFrame | None = None) -> DataFrame:
    """Simple paths of at most max_nodes nodes between the ends of every pair (query_id, source, target).

    Paths are made and cut once for each two ends that have some, then joined to the pairs. Per pair the max_paths
    shortest stay, ties by node keys. A pair with equal ends is one path of one node, known or not. outs, if given, holds
    all edges out of the sources.
    """
    if not 2 <= max_nodes <= MAX_PATH_NODES:
        raise ValueError(f"max_nodes must be from 2 to {MAX_PATH_NODES}")
    size = F.size("path")
    cut = Window.partitionBy("node", "target").orderBy("path_length", "path")
    found = _suffixes(edges, pairs.filter("source <> target"), max_nodes - 1, directed, outs).withColumn("path_length", size).withColumn("rank", F.row_number().over(cut)).filter(F.col("rank") <= max_paths)
    far = pairs.filter("source <> target").select("query_id", "source", "target").join(found.withColumnRenamed("node", "source"), ["source", "target"])
    same = pairs.filter("source = target").select("query_id", "source", "target", F.array("source").alias("path"), F.lit(1).alias("path_length"), F.lit(1).alias("rank"))
    score = F.lit(LONG_PATH_SCORE)
    for n, s in sorted(PATH_SCORES.items(), reverse=True):
        score = F.when(F.col("path_length") == n, s).otherwise(score)
    return far.unionByName(same).select("query_id", "source", "target", "path", "path_length", (F.col("path_length") - 1).alias("num_hops"), score.alias("score"), "rank")


def subgraph_search(edges: DataFrame, centers: DataFrame, max_depth: int = 2, max_nodes: int = 50, max_edges: int = 100, direction: str = "both") -> tuple[DataFrame, DataFrame]:
    """Nodes (query_id, id, depth, is_center) and edges around the centres (query_id, entity).

    Nodes are admitted level by level in the order of their keys until max_nodes; centres always.
    Edges among admitted nodes count whatever the direction; the first max_edges stay, equal ones once.
    Of a node only the first max_nodes neighbours by key are followed: a neighbour is admitted after
    all lesser ones of the same node, so one further on can't be among the first max_nodes of all.
    """
    out_going = edges.select(F.col("src").alias("node"), F.col("dst").alias("next"))
    coming = out_going.select(F.col("next").alias("node"), F.col("node").alias("next"))
    either = out_going.unionByName(coming)
    ends = out_going if direction == "out" else coming if direction == "in" else either
    first = Window.partitionBy("node").orderBy("next")
    start, rows = settle(centers.select("query_id", F.col("entity").alias("id")).distinct(), "centres")
    known, n = settle(within(either, "node", start.select(F.col("id").alias("node")), rows).select("node").distinct(), "known")
    level = start.join(hinted(known, n), F.col("id") == F.col("node"), "left_semi").withColumn("depth", F.lit(0))
    found, size_found = level, rows
    for depth in range(1, max_depth + 1):
        # of queries that have all their nodes nothing is expanded, nor what is beyond the cap
        size = F.count(F.lit(1)).over(Window.partitionBy("query_id"))
        level, rows = settle(found.withColumn("_n", size).filter((F.col("_n") < max_nodes) & (F.col("depth") == depth - 1)).select("query_id", "id"), "level")
        if not rows:
            break
        step = within(ends, "node", level.select(F.col("id").alias("node")), rows)
        step = dealt(step.withColumn("_part", F.pmod(F.xxhash64("next"), F.lit(SPREAD))), "node", "_part").distinct()
        step = step.withColumn("_r", F.row_number().over(first)).filter(F.col("_r") <= max_nodes).select("node", "next")
        new = level.join(step, F.col("id") == F.col("node")).select("query_id", F.col("next").alias("id")).distinct()
        new = new.join(found.select("query_id", "id"), ["query_id", "id"], "left_anti").withColumn("depth", F.lit(depth))
        cut = Window.partitionBy("query_id").orderBy("depth", "id")
        found = found.unionByName(new).withColumn("_r", F.row_number().over(cut)).filter((F.col("_r") <= max_nodes) | (F.col("depth") == 0)).drop("_r")
        found, size_found = settle(found, "found")
    nodes = found.select("query_id", "id", "depth", (F.col("depth") == 0).alias("is_center"))
    held = nodes.select("query_id", "id")
    # an edge is joined first by the end that fewer queries hold, so a hub's edges don't meet all of its queries
    per = held.groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    both = edges.select("src", "relation", "dst", "ord")
    for end in ("src", "dst"):  # before edges are dealt
        both = maybe_within(both, end, held.select(F.col("id").alias("node")), size_found)
    both = both.join(per.select(F.col("id").alias("src"), F.col("n").alias("_s")), "src").join(per.select(F.col("id").alias("dst"), F.col("n").alias("_d")), "dst")
    by_src = F.col("_s") <= F.col("_d")
    both = both.select("src", "relation", "dst", "ord", F.when(by_src, F.col("src")).otherwise(F.col("dst")).alias("_a"), F.when(by_src, F.col("dst")).otherwise(F.col("src")).alias("_b"))
    inner = both.join(held.withColumnRenamed("id", "_a"), "_a").join(held.withColumnRenamed("id", "_b"), ["query_id", "_b"])
    cut = Window.partitionBy("query_id").orderBy("relation", "src", "dst", "ord")
    kept = inner.withColumn("_r", F.row_number().over(cut)).filter(F.col("_r") <= max_edges)
    return nodes, kept.select("query_id", F.col("src").alias("head"), "relation", F.col("dst").alias("tail")).distinct()


def entity_pairs(members: DataFrame, group: str, entity: str) -> DataFrame:
    """Unordered pairs of the distinct entities of each group; for groups of bounded size, such as a question's entities."""
    one = members.select(group, entity).distinct()
    a, b = one.withColumnRenamed(entity, "source"), one.withColumnRenamed(entity, "target")
    return a.join(b, group).filter("source < target")


def graph_stats(nodes: DataFrame, edges: DataFrame, top: int = 20) -> DataFrame:
    """kind, key, n: the top node types and relations by count, and the totals."""
    total = nodes.agg(F.lit("total").alias("kind"), F.lit("nodes").alias("key"), F.count(F.lit(1)).alias("n")).unionByName(
        edges.agg(F.lit("total").alias("kind"), F.lit("edges").alias("key"), F.count(F.lit(1)).alias("n"))
    )
    types = nodes.groupBy(F.col("type").alias("key")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "key").limit(top)
    kinds = edges.groupBy(F.col("relation").alias("key")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "key").limit(top)
    return total.unionByName(types.select(F.lit("node_type").alias("kind"), "key", "n")).unionByName(kinds.select(F.lit("relation").alias("kind"), "key", "n"))


def degrees(edges: DataFrame) -> DataFrame:
    """node, out_degree, in_degree over parallel edges."""
    ends = edges.select(F.col("src").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionByName(edges.select(F.col("dst").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    return ends.groupBy("node").agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"))
