"""Connected components of a link table, as Spark jobs.

Every node takes the smallest label among itself and its neighbours, then the
label of its label (pointer jumping), until nothing changes.  A star's centre
may have any number of links: minima are combined before the shuffle.  Each
round is checkpointed, so a lost executor costs a round at most; the driver
sees one number a round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpoint_dir


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, comp``: every node of a link, and the smallest node it can
    reach.  Nulls are no nodes; an empty table gives an empty one."""
    checkpoint_dir(links.sparkSession)
    links = links.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).checkpoint()
    labels = (both.groupBy("a").agg(F.min("b").alias("m"))
              .select(F.col("a").alias("node"), F.least("a", "m").alias("comp")).checkpoint())
    while True:
        around = (both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("comp").alias("m")))
        near = (labels.join(around, labels["node"] == around["a"])
                .select("node", F.col("comp").alias("old"), F.least("comp", "m").alias("comp")))
        far = labels.select(F.col("node").alias("at"), F.col("comp").alias("next"))
        jumped = (near.join(far, near["comp"] == far["at"], "left")
                  .select("node", "old", F.least("comp", F.coalesce("next", "comp")).alias("comp"))).checkpoint()
        changed = jumped.agg(F.coalesce(F.sum((F.col("comp") != F.col("old")).cast("long")), F.lit(0))).first()[0]
        labels = jumped.select("node", "comp")
        if not changed:
            return labels
