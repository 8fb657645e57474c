"""Connected components of a link table, in Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitchload.session import cut


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, comp) for every node of `links`; comp is the smallest node that it is joined to.

    Every round takes the smallest label among a node and its neighbours and then the label of
    that label, so a chain's length halves. Rounds are written tables, so a lost executor repeats
    one round at most. Null ends and loops are ignored; an empty link table gives an empty result.
    """
    links = links.select(F.col(a).alias("src"), F.col(b).alias("dst")).where("src <> dst")
    both = cut(links.unionByName(links.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct(), "links")
    lab = cut(both.groupBy(F.col("src").alias("node")).agg(F.min("dst").alias("m"))
              .select("node", F.least("node", "m").alias("comp")), "labels")
    while True:
        near = (both.join(lab.select(F.col("node").alias("dst"), "comp"), "dst")
                .groupBy(F.col("src").alias("node")).agg(F.min("comp").alias("m")))
        one = lab.join(near, "node").select("node", F.col("comp").alias("old"), F.least("comp", "m").alias("via"))
        jump = lab.select(F.col("node").alias("via"), F.col("comp").alias("far"))
        new = cut(one.join(jump, "via").select("node", F.least("via", "far").alias("comp"),
                                               (F.least("via", "far") != F.col("old")).alias("moved")), "labels")
        if new.where("moved").limit(1).count() == 0:
            return new.select("node", "comp")
        lab = new.select("node", "comp")
