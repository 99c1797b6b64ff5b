"""Connected components of a link table, without collecting it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import passing, written


def components(links: DataFrame) -> DataFrame:
    """(id, comp) for every id in links (a, b); comp is the smallest id that can be reached.

    Each round every id takes the smallest label among its neighbours, the root of a label takes
    the smallest label offered to any of its members, and labels are looked up once more. Labels
    so halve the way to their root: the rounds grow with the logarithm of the longest path."""
    with passing() as kept:
        both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        edges = written(both.where("a <> b").distinct(), "edges")
        labels = written(edges.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("m")).select("id", F.least("id", "m").alias("comp")), "labels")
        while True:
            near = edges.join(labels, edges["b"] == labels["id"]).groupBy("a").agg(F.min("comp").alias("near"))
            step = labels.join(near, labels["id"] == near["a"], "left").select("id", "comp", F.least("comp", "near").alias("next"))
            step = written(step, "step")
            roots = step.groupBy(F.col("comp").alias("root")).agg(F.min("next").alias("offer"))
            hooked = step.join(roots, step["id"] == roots["root"], "left").select("id", "comp", F.least("next", "offer").alias("next"))
            hooked = written(hooked, "hooked")
            up = hooked.select(F.col("id").alias("up"), F.col("next").alias("top"))
            new = hooked.join(up, hooked["next"] == up["up"], "left").select("id", "comp", F.least("next", "top").alias("next"))
            new = written(new, "labels")
            moved = new.where("next < comp").limit(1).count()
            labels = new.select("id", F.col("next").alias("comp"))
            if not moved:
                return kept(labels, "components")
