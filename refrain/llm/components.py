"""Connected components by alternating large-star and small-star (Kiveris et al., 2014)."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import done, stored


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Large: links each larger neighbour of u to the least of u and its neighbours. Small: links u and its smaller
    neighbours to the least of these."""
    if large:
        near = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        near = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = near.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    met = near.join(least, "u")
    if large:
        out = met.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = met.select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v"))
    return out.where("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of edges(u, v): component is the least node that it reaches.

    Loops (u = v) and edges with a null end are ignored; repeated edges and both directions count once; no edges give
    no rows. Every round is stored, and only a count and a checksum of the edges reach the driver. Rounds grow
    with the logarithm of the number of nodes.
    """
    edges = stored(edges.where("u <> v").select("u", "v").distinct(), "edges")
    seen = None
    while True:
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.sum((F.col("u") < F.col("v")).cast("int"))).first()
        if now[0] == 0 or tuple(now[:2]) == seen:
            out = stored(edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct(), "components")
            done(edges)
            return out
        seen = tuple(now[:2])
        last, edges = edges, stored(_star(_star(edges, large=True), large=False), "edges")
        done(last)
