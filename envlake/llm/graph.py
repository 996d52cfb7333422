"""Connected components of an undirected link table, by label spreading and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from envlake.llm.common import save


def components(links: DataFrame, rounds: int = 100) -> DataFrame:
    """``(node, label)`` for every end of a link ``(a, b)``: the smallest node reachable.

    Each round takes the smallest label among a node's neighbours (grouped minimum, combined
    before the shuffle, so a hub costs no more than its rows) and then the label of that label.
    Labels are written to the shared folder each round; an empty link table gives no rows.
    """
    ends = save(links.select("a", "b").unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
                .where("a <> b").distinct(), "links")
    labels = save(ends.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("b"))
                  .select("node", F.least("node", "b").alias("label")), "labels")
    for _ in range(rounds):
        near = ends.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("l"))
        spread = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "l").alias("label"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("next"))
        found = save(spread.join(jump, "label", "left")
                     .select("node", "old", F.least("label", F.coalesce("next", "label")).alias("label")), "labels")
        labels = found.select("node", "label")
        if found.where("label < old").isEmpty():
            break
    else:
        raise RuntimeError("components did not settle")
    return labels
