"""Connected components of links, by the smallest label of the neighbours and of the label's own label."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.llm.common import materialize, release, sized

#: Links of a task.
LINKS = 200_000


def components(links: DataFrame) -> DataFrame:
    """(node, label) of every node of links (a, b): the label is the smallest node that it reaches.

    Links may repeat, in either direction, and lead to themselves; links with a null end are left out.
    Each round is one table in the shared folder, so a lost executor costs a round at most.
    """
    rows = 2 * links.count()
    links = links.where(F.col("a").isNotNull() & F.col("b").isNotNull())
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = materialize(sized(both, rows, LINKS), "links")
    labels = both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label"))
    labels = last = materialize(sized(labels, rows, LINKS), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        found = labels.join(near, "node").select("node", F.col("label").alias("was"), F.least("label", "near").alias("label"))
        over = labels.select(F.col("node").alias("label"), F.col("label").alias("further"))
        found = found.join(over, "label", "left").select("node", "was", F.least("label", "further").alias("label"))
        found = materialize(sized(found, rows, LINKS), "labels")
        release(last)
        labels, last = found.select("node", "label"), found
        if found.where("label <> was").isEmpty():
            release(both)
            return labels
