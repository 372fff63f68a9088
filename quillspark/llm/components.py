"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import join_hot, stored


def components(links: DataFrame) -> DataFrame:
    """(id, component) for every end of ``links`` (u, v); component is the least id that links reach.

    Every id takes the least label among itself and its neighbours, then the label of its label, until none changes. Each round is
    written to the shared folder; the number of rounds is about the logarithm of the longest path. An id with a large share of the links,
    and a label with a large share of the ids, are dealt to many tasks.
    """
    both = stored(links.select("u", "v").union(links.select("v", "u")).where(F.col("u") != F.col("v")), "links")
    labels = stored(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("component")).withColumnRenamed("u", "id"), "labels")
    while True:
        near = join_hot(both, labels.withColumnRenamed("id", "v"), "v", "u").groupBy("u").agg(F.min("component").alias("_near"))
        low = stored(labels.join(near, labels["id"] == near["u"]).select("id", "component", F.least("component", "_near").alias("_low")), "labels")
        jump = labels.select(F.col("id").alias("_low"), F.col("component").alias("_jump"))
        new = stored(join_hot(low, jump, "_low", "id").select("id", F.least("_low", "_jump").alias("component"), (F.least("_low", "_jump") != F.col("component")).alias("_new")), "labels")
        labels = new.drop("_new")
        if new.where("_new").isEmpty():
            return labels
