"""Connected components of an edge table, without sending edges to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


#: A key with over 1 / HOT of all rows is hot; there are HOT such keys at most.
HOT = 10_000
FEW = 256


def join_spread(rows: DataFrame, groups: DataFrame, key: str) -> DataFrame:
    """``rows`` with the columns of ``groups``, which has one row for each ``key`` and counts its rows in ``n``.

    Hot keys are broadcast, so their rows stay where they are: HOT keys at most, since each
    has over 1 / HOT of all rows. All others are joined by a shuffle. Both tables should be
    written ones; they are read twice.
    """
    total = groups.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    hot = F.col("n") > max(total // HOT, FEW)
    heavy = F.broadcast(groups.where(hot).drop("n"))
    return rows.join(heavy, key).unionByName(rows.join(heavy.select(key), key, "left_anti").join(groups.where(~hot).drop("n"), key))


def connected_components(edges: DataFrame, max_rounds: int = 60, about: int | None = None) -> DataFrame:
    """(a, b) links of ids of one type, long or binary -> (node, root): the smallest id of the component, for each of its other nodes.

    Alternates the two star contractions: every node hands its neighbours to the smallest
    one it knows, first for larger neighbours, then for smaller ones. Hubs with a large share
    of all links are joined by broadcast. The rounds grow with
    the logarithm of the longest chain. Only a count and a checksum reach the driver.
    about: of how many links, if known; their table has files for so many, the later ones for as many as were left.
    """
    pairs = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    pairs = materialize(pairs, "links", about)
    n = pairs.count()
    seen = None
    for _ in range(max_rounds):
        both = pairs.select("u", "v").union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("m", "u").alias("m"), "n")
        large = join_spread(both, materialize(least, "least", 2 * n), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = materialize(large, "large", n)
        low = materialize(large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")), "low", n)
        small = join_spread(large, low, "u")
        small = small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v"))).distinct()
        pairs = materialize(small, "links", n)
        state = pairs.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen, n = state, state[0]
    else:
        raise RuntimeError("components did not settle; raise max_rounds")
    return pairs.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("node"), "root")
