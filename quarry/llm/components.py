"""Connected components of an edge table, by alternating large-star and small-star steps.

Each step is one group-by and one join over the edges, so no component is gathered anywhere; after a number of rounds
that grows with the logarithm of the components' size every vertex hangs on the smallest id of its component.

Defined results: edges with a null end or equal ends say nothing; repeated edges count once; no edges give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import discard, materialize


def connected_components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """vertex and component (the smallest id that it reaches) of every vertex but the components' smallest ones."""
    pairs = edges.select(F.greatest(a, b).alias("v"), F.least(a, b).alias("u")).filter("v <> u and v is not null and u is not null").distinct()
    pairs = materialize(pairs, "components")
    if pairs.isEmpty():
        return pairs.select(F.col("v").alias("vertex"), F.col("u").alias("component"))
    seen = pairs.agg(F.count("*"), F.bit_xor(F.xxhash64("v", "u"))).first()
    while True:
        # Large star: hang the larger neighbours of each vertex on its smallest neighbour (or itself).
        both = pairs.unionByName(pairs.select(F.col("u").alias("v"), F.col("v").alias("u")))
        least = both.groupBy("v").agg(F.min("u").alias("m")).select(F.col("v").alias("w"), F.least("v", "m").alias("m"))
        large = both.join(least, F.col("v") == F.col("w")).filter(F.col("u") > F.col("v")).select(F.col("u").alias("v"), F.col("m").alias("u")).filter("v <> u").distinct()
        # Small star: hang the smaller neighbours of each vertex, and the vertex, on its smallest neighbour.
        floor = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(floor, "v").select(F.explode(F.array(F.struct(F.col("u").alias("v"), F.col("m").alias("u")), F.struct("v", F.col("m").alias("u")))).alias("e")).select("e.v", "e.u").filter("v <> u").distinct()
        after = materialize(small, "components")
        now = after.agg(F.count("*"), F.bit_xor(F.xxhash64("v", "u"))).first()
        discard(pairs)
        pairs = after
        if now == seen:
            return pairs.groupBy(F.col("v").alias("vertex")).agg(F.min("u").alias("component"))
        seen = now
