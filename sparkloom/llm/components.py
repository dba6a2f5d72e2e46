"""Connected components of a table of links, without any of it on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import discard, materialise

#: Links or labels that one task handles.
ROWS_PER_TASK = 200_000


def components(links: DataFrame) -> DataFrame:
    """Rows (``node``, ``comp``) for all nodes of ``links`` (columns ``a``, ``b``, bigint).

    ``comp`` is the smallest node of the component.  In each round every node joins
    its smallest neighbour, chains of such steps are shortened, and the links are
    drawn anew between what remains; the number of links at least halves.  Groups
    are only reduced by partial aggregation, never gathered.  Few links are handled by
    few tasks.
    """
    most = max(1, int(links.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def held(df: DataFrame, name: str, rows: int) -> DataFrame:
        tasks = 1 + rows // ROWS_PER_TASK
        return materialise(df.coalesce(tasks) if tasks < most else df, name)

    n = links.count()
    edges = held(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct(), "edges", n)
    nodes = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()
    labels = held(nodes.withColumn("comp", F.col("node")), "labels", 2 * n)
    left = n
    while left and (left := edges.count()):
        both = edges.union(edges.select("b", "a"))
        up = both.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m"))
        up = held(up.select("u", F.least("u", "m").alias("p")), "parents", 2 * left)
        for _ in range(2):
            higher = up.select(F.col("u").alias("p"), F.col("p").alias("q"))
            shorter = held(up.join(higher, "p").select("u", F.col("q").alias("p")), "parents", 2 * left)
            discard(up)
            up = shorter
        new = labels.join(up, labels["comp"] == up["u"], "left").select("node", F.coalesce("p", "comp").alias("comp"))
        new = held(new, "labels", 2 * n)
        a = up.select(F.col("u").alias("a"), F.col("p").alias("pa"))
        b = up.select(F.col("u").alias("b"), F.col("p").alias("pb"))
        drawn = edges.join(a, "a").join(b, "b").where("pa != pb")
        drawn = held(drawn.select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct(), "edges", left)
        for old in (edges, labels, up):
            discard(old)
        edges, labels = drawn, new
    discard(edges)
    return labels
