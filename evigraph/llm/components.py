"""Connected components of a table of links, by alternating large-star and small-star steps.

Each step keeps connectivity and brings every node nearer to the smallest node of its component;
a star around this node is where it ends. Links stay in tables; only counts reach the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evigraph.llm.shared import Scratch


def _sum(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v") % F.lit(1 << 40)).alias("s")).first()
    return row["n"], row["s"]


def components(links: DataFrame, a: str, b: str, scratch: Scratch, tag: str = "components") -> DataFrame:
    """Columns id, component (smallest id) for every id on a link; null ends are ignored.

    First every node without a greater neighbour is taken off: its neighbours are linked among
    themselves and it follows the least of them. The steps then turn on what is left. Hot nodes
    are joined, not gathered, so that skewed joins can split them. Repeated and self-links do no
    harm; without links the result is empty.
    """
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u is not null and v is not null and u <> v").distinct()
    whole = scratch.save(edges, f"{tag}-links")
    least = scratch.save(whole.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")), f"{tag}-least")
    inner = least.join(whole.select(F.col("v").alias("u")).distinct(), "u", "left_semi").select("u", F.col("m").alias("v"))
    several = whole.join(least.filter("n > 1"), "u").filter("v <> m").select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v"))
    core = _stars(inner.unionByName(several).distinct(), scratch, tag)
    found = scratch.save(core, f"{tag}-core")
    followers = least.select(F.col("u").alias("id"), "m").join(found.select("id"), "id", "left_anti").join(found.select(F.col("id").alias("m"), "component"), "m", "left").select("id", F.coalesce("component", "m").alias("component"))
    roots = whole.select(F.col("v").alias("id")).distinct().join(least.select(F.col("u").alias("id")), "id", "left_anti").join(found.select("id"), "id", "left_anti").select("id", F.col("id").alias("component"))
    return found.unionByName(followers).unionByName(roots)


def _stars(links: DataFrame, scratch: Scratch, tag: str) -> DataFrame:
    """id, component for every id on the distinct links u > v, by large-star and small-star steps."""
    edges, known, turn = scratch.save(links, f"{tag}-0"), None, 0
    while True:
        now = _sum(edges)
        if now == known or not now[0]:
            break
        known, turn = now, turn + 1
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        # every edge of large points down, so the neighbours of u that are not above it are its v
        small = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(small, "u")
        edges_next = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").unionByName(small.select("u", F.col("m").alias("v"))).distinct()
        edges_next = scratch.save(edges_next, f"{tag}-{turn}")
        scratch.drop(f"{tag}-{turn - 1}")
        edges = edges_next
    stars = edges.select(F.col("u").alias("id"), F.col("v").alias("component"))
    roots = edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    return stars.unionByName(roots)


def spanning(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Positions of links a - b of n nodes, numbered from 0, that connect all that the links connect, without a circle."""
    label, live, kept = np.arange(n), np.flatnonzero(a != b), []
    while len(live):
        x, y = label[a[live]], label[b[live]]
        low, high = np.minimum(x, y), np.maximum(x, y)
        top, at = np.unique(high, return_index=True)  # each class takes one link to a lesser one
        kept.append(live[at])
        label[top] = low[at]
        while (label[label] != label).any():
            label = label[label]
        live = live[label[a[live]] != label[b[live]]]
    return np.sort(np.concatenate(kept)) if kept else np.empty(0, np.int64)


def dealt(members: DataFrame, group: str, comp: str, ident: str, weight: str, size: int, slots: int) -> DataFrame:
    """Deal the members of groups of more than one component to parts, and these to slots: columns _b, _i, _j, _slot besides those of members.

    Any two members of a group that are in different components meet in some part (rows of block
    _i with rows of block _j, as each row's _b says). A group whose weights add to at most ``size``
    is the one part (0, 0). In a larger one, the members of its largest component are dealt to one
    block each and all others, if they weigh at most ``size``, to every block. Otherwise each member
    goes to every pair of blocks with its own. Groups of one component are left out.
    """
    tally = members.groupBy(group, comp).agg(F.sum(weight).alias("_w"))
    tally = tally.groupBy(group).agg(F.sum("_w").alias("_c"), F.count(F.lit(1)).alias("_k"), F.max(F.struct("_w", comp)).alias("_top")).filter("_k > 1")
    rows = members.join(tally.select(group, "_c", F.col("_top")[comp].alias("_most"), (F.col("_c") - F.col("_top._w")).alias("_others")), group)
    n = F.ceil(F.col("_c") / F.lit(size)).cast("int")
    rows = rows.withColumn("_p", n).withColumn("_own", F.pmod(F.xxhash64(ident), F.col("_p")).cast("int"))
    star, major = F.col("_others") <= size, F.col(comp) == F.col("_most")
    rows = rows.withColumn("_o", F.explode(F.when(star & major, F.array("_own")).otherwise(F.sequence(F.lit(0), F.col("_p") - 1))))
    i, j = F.when(star, F.col("_o")).otherwise(F.least("_own", "_o")), F.when(star, F.col("_o")).otherwise(F.greatest("_own", "_o"))
    rows = rows.select(*members.columns, F.when(star, F.col("_o")).otherwise(F.col("_own")).alias("_b"), i.alias("_i"), j.alias("_j"))
    return rows.withColumn("_slot", F.pmod(F.xxhash64(group, "_i", "_j"), F.lit(slots)).cast("int"))


def blocked(members: DataFrame, group: list[str], count: str, ident: str, size: int, slots: int) -> DataFrame:
    """Deal the members of groups to pairs of blocks, and these to slots: columns _b, _i, _j, _slot besides those of members.

    A group of at most ``size`` is the one block pair (0, 0). A larger one is split by a hash of
    ident into blocks (_b is a row's block); each row goes to every pair with its own block, so any
    two rows of a group meet in exactly one pair where _i <= _j: the pair of their blocks. A slot
    takes many small groups, or few pairs of large ones; rows of a slot are told apart by segments().
    """
    n = F.greatest(F.lit(1), F.ceil(F.col(count) / F.lit(size))).cast("int")
    own = members.withColumn("_n", n).withColumn("_b", F.pmod(F.xxhash64(ident), F.col("_n")).cast("int"))
    dealt = own.withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    dealt = dealt.select("*", F.least("_b", "_o").alias("_i"), F.greatest("_b", "_o").alias("_j")).drop("_o", "_n")
    return dealt.withColumn("_slot", F.pmod(F.xxhash64(*group, "_i", "_j"), F.lit(slots)).cast("int"))


def segments(table: pa.Table, columns: list[str]) -> Iterator[np.ndarray]:
    """Row numbers of each distinct combination of values of integer columns."""
    values = [table.column(c).to_numpy() for c in columns]
    order = np.lexsort(values[::-1])
    new = np.zeros(len(order), bool)
    for v in values:
        new[1:] |= v[order][1:] != v[order][:-1]
    yield from np.split(order, np.flatnonzero(new))
