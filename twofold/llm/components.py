"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twofold.sources.tables import stage


def components(links: DataFrame) -> DataFrame:
    """(doc_id, component_id) of every document that has a link.

    ``links`` has columns a and b. Each round gives a document the smallest label
    among its own and its neighbours', then the label of that label's document,
    so chains shorten by doubling. Rounds end when no label changes; labels are
    written to the shared folder between rounds. An empty table gives an empty one.
    """
    both = stage(
        links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(),
        "links",
    )
    labels = stage(both.groupBy(F.col("a").alias("doc_id")).agg(F.least(F.min("b"), F.first("a")).alias("component_id")), "labels")
    while True:
        near = (
            both.join(labels.withColumnsRenamed({"doc_id": "b", "component_id": "near"}), "b")
            .groupBy(F.col("a").alias("doc_id"))
            .agg(F.min("near").alias("near"))
        )
        least = labels.join(near, "doc_id").select(
            "doc_id", F.col("component_id").alias("was"), F.least("component_id", "near").alias("now")
        )
        jump = labels.select(F.col("doc_id").alias("now"), F.col("component_id").alias("far"))
        state = stage(
            least.join(jump, "now", "left").select("doc_id", "was", F.least("now", F.coalesce("far", "now")).alias("component_id")),
            "labels",
        )
        labels = state.select("doc_id", "component_id")
        if state.where("was <> component_id").isEmpty():
            return labels
