"""Connected components of a table of links, by passing the smallest label and jumping along labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch


def components(scratch: Scratch, links: DataFrame, name: str) -> DataFrame:
    """node, comp (the smallest node reachable) for links(a, b). Each step is a written table."""
    both = links.select("a", "b").union(links.select("b", "a")).distinct()
    both = scratch.table(both, f"{name}-links")
    labels = scratch.table(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("comp")), f"{name}-0")
    step = 0
    while True:
        step += 1
        heard = both.join(labels.select(F.col("node").alias("b"), "comp"), "b").groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("heard"))
        heard = labels.join(heard, "node").select("node", "comp", F.least("comp", "heard").alias("low"))
        jump = heard.select(F.col("node").alias("low"), F.col("low").alias("next")).distinct()
        new = heard.join(jump, "low", "left").select("node", F.coalesce("next", "low").alias("comp"), F.col("comp").alias("was"))
        new = scratch.table(new, f"{name}-{step}")
        if new.filter("comp <> was").isEmpty():
            scratch.drop(f"{name}-{step - 1}")
            return new.select("node", "comp")
        scratch.drop(f"{name}-{step - 1}")
        labels = new.select("node", "comp")
