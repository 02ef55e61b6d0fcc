"""Connected components over links, by contracting every node into its least neighbour."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codewarden.llm.common import written


def connected(links: DataFrame) -> DataFrame:
    """(node, part): one node of its component for each node that ``links`` (a, b) name.

    In a round each node goes into the least of itself and its neighbours, and links are carried over to
    what their ends became; links within one node fall away. Stars, the usual shape, are gone after
    one round, and with ids in no particular order long paths shrink geometrically. A busy node's
    neighbours meet in a map-side minimum, and joins on it are split by adaptive execution. Each
    round is a table in the shared folder.
    """
    links = links.select("a", "b").filter("a <> b")
    found = None
    while True:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        into = written(
            both.groupBy(F.col("a").alias("node"))
            .agg(F.min("b").alias("near"))
            .select("node", F.least("node", "near").alias("part")),
            "parts",
        )
        if found is None:
            found = into
        else:
            then = into.select(F.col("node").alias("part"), F.col("part").alias("then"))
            found = found.join(then, "part", "left").select(
                "node", F.coalesce("then", "part").alias("part")
            )
        links = links.join(into.select(F.col("node").alias("a"), F.col("part").alias("to_a")), "a")
        links = links.join(into.select(F.col("node").alias("b"), F.col("part").alias("to_b")), "b")
        links = written(
            links.select(F.col("to_a").alias("a"), F.col("to_b").alias("b")).filter("a <> b").distinct(),
            "links",
        )
        if links.isEmpty():
            return found
