"""Connected components of links between ids, as joins and groupings only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from firelake.llm.shared import stored
from firelake.operators.skew import join_reduced


def _toward_minimum(links: DataFrame, both_ways: bool) -> DataFrame:
    """Link the neighbours of each id to the smallest id among them and itself.

    With `both_ways` every id moves its larger neighbours, else its smaller ones and itself.
    """
    if both_ways:
        near = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        near = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = near.groupBy("a").agg(F.least("a", F.min("b")).alias("least"))
    moved = join_reduced(near, least, ["a"], "inner")
    if both_ways:
        moved = moved.where("b > a").select(F.col("b").alias("a"), F.col("least").alias("b"))
    else:
        moved = moved.select(F.col("b").alias("a"), F.col("least").alias("b")).union(
            least.select("a", F.col("least").alias("b"))
        )
    return moved.where("a <> b")


def components(links: DataFrame) -> DataFrame:
    """(node, component) of all ids in `links(a, b)`; a component is named by its smallest id.

    Alternates the two star operations until the links are stars: each is one grouping and
    one join, and the number of turns grows with the logarithm of the size.
    Self links and nulls are ignored; an empty table gives an empty result.
    """
    links = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    links = stored(links, "links")
    while True:
        # A star reads its links twice; stored in between, no star is planned inside another one's plan.
        links = stored(_toward_minimum(links, True), "links")
        links = stored(_toward_minimum(links, False).distinct(), "links")
        ups = links.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down"))
        downs = links.select(F.col("b").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down"))
        ends = ups.union(downs).groupBy("node").agg(F.sum("up").alias("ups"), F.max("down").alias("down"))
        # Done when every id has one link, to an id that has none.
        if ends.where("ups > 1 OR (ups = 1 AND down = 1)").isEmpty():
            break
    members = links.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return members.union(members.select(F.col("component").alias("node"), "component").distinct())
