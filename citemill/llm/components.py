"""Connected components of links, by repeated joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citemill.session import stage


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component): the smallest node that each linked node can reach.

    Every round takes the smallest label among a node and its neighbours and
    then the label of that label, so long chains halve. Rounds are written to
    the shared folder, which cuts their lineage. Nodes without links are not in
    the result; null ends link nothing.
    """
    pairs = links.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    # Both directions by explode: a union would keep the partitioning of its parts.
    both = F.explode(F.array(F.struct(F.col(a).alias("u"), F.col(b).alias("v")), F.struct(F.col(b).alias("u"), F.col(a).alias("v"))))
    edges = stage(pairs.select(both.alias("e")).select("e.u", "e.v").distinct(), "edges")
    labels = stage(edges.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("label")), "labels")
    total = labels.agg(F.sum(F.col("label").cast("decimal(38,0)"))).first()[0]
    while True:
        near = (
            edges.join(labels.select(F.col("u").alias("v"), "label"), "v").groupBy("u").agg(F.min("label").alias("near"))
        )
        best = labels.join(near, "u").select("u", F.least("label", "near").alias("label"))
        up = labels.select(F.col("u").alias("label"), F.col("label").alias("above"))
        labels = stage(best.join(up, "label").select("u", F.least("label", "above").alias("label")), "labels")
        now = labels.agg(F.sum(F.col("label").cast("decimal(38,0)"))).first()[0]
        if now == total:
            return labels.select(F.col("u").alias("node"), F.col("label").alias("component"))
        total = now
