"""Connected components of a link table, in the table's own distribution."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docrisk.llm.scratch import Shelf


def components(links: DataFrame, shelf: Shelf, name: str) -> DataFrame:
    """``id`` and ``class_id`` (the smallest id of its component) of all ids in ``links`` (``a``, ``b``).

    Every id takes the smallest label among itself and its neighbours, then the label of that label,
    until nothing changes. Jumping to the label's label halves the way to the smallest id each time,
    so a chain of n takes about log n rounds and a star two. Each round is written to ``shelf`` under
    ``name`` in place of the one before; ``links`` is read in each, so it should be written already. Labels
    are reduced by partial aggregation, so a hub costs no more than its links. Joins are merge joins: nothing
    goes through the driver.
    """
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a != b")
    labels = both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("m")).select("id", F.least("id", "m").alias("class_id"))
    while True:
        near = both.join(labels.hint("merge"), both["b"] == labels["id"]).groupBy("a").agg(F.min("class_id").alias("m"))
        lower = labels.join(near.hint("merge"), labels["id"] == near["a"]).select("id", "class_id", F.least("class_id", "m").alias("l"))
        jump = labels.select(F.col("id").alias("l"), F.col("class_id").alias("far"))
        jumped = lower.join(jump.hint("merge"), "l", "left").select("id", F.least("l", "far").alias("class_id"), (F.least("l", "far") < F.col("class_id")).alias("changed"))
        new = shelf.put(name, jumped)
        labels = new.select("id", "class_id")
        if new.where("changed").isEmpty():
            return labels
