"""Connected components of an undirected graph of long node ids.

Alternating large-star and small-star steps: each node links its larger
(then its smaller) neighbours to the least node it sees, until nothing
changes; then every node is linked to its component's least node. Each step
is an aggregate and a join on the node, and is staged, so the lineage stays
short and no component is ever gathered anywhere. A node that most links
share is split over several tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from souk.llm.common import staged
from souk.plans.skew import salted_join


def _star(links: DataFrame, large: bool) -> DataFrame:
    """``links`` (u, v) with u > v."""
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    seen = both if large else links
    least = seen.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    joined = salted_join(seen, least, "u", spread_by=["v"])
    if large:
        out = joined.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            least.select("u", F.col("m").alias("v"))
        )
    return out.filter("u <> v").distinct()


def _summary(links: DataFrame) -> tuple:
    mixed = F.xxhash64("u", "v")
    return tuple(
        links.agg(
            F.count(F.lit(1)),
            F.sum(mixed.bitwiseAND(0xFFFFFFFF)),
            F.sum(F.shiftrightunsigned(mixed, 32)),
        ).first()
    )


def roots(links: DataFrame) -> DataFrame:
    """(u, v) links in any direction -> (node, root) for every linked node
    that isn't its component's least node."""
    now = staged(
        links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .filter("u <> v")
        .distinct(),
        "links",
    )
    last = None
    while (summary := _summary(now)) != last:
        last = summary
        if not summary[0]:
            break
        now = staged(_star(_star(now, large=True), large=False), "links")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
