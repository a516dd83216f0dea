"""Connected components of an undirected graph held as a table of links, by contraction with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import materialize


def connected_components(links: DataFrame) -> DataFrame:
    """(node, component) of every node of `links` (src, dst; long): the least node that can be reached.

    Each round hangs a node on its least neighbour, jumps to the roots and contracts the links; loops and repeated
    links vanish. All state is in tables of the shared folder. The tables are joined on keys that can be hot; AQE splits those.
    """
    pair = lambda a, b: (F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo"))
    live = materialize(links.where("src <> dst").select(*pair(F.col("src"), F.col("dst"))).distinct(), "links")
    label: DataFrame | None = None
    while not live.isEmpty():
        ends = live.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionAll(live.select("lo", "hi"))
        parent = materialize(ends.groupBy("u").agg(F.min("v").alias("v")).select("u", F.least("u", "v").alias("p")), "parents")
        while True:  # every chain of parents falls, so this ends
            up = parent.select(F.col("u").alias("p"), F.col("p").alias("q"))
            jumped = materialize(parent.join(up, "p").select("u", F.col("q").alias("p"), (F.col("q") != F.col("p")).alias("moved")), "parents")
            parent = jumped.select("u", "p")
            if jumped.where("moved").isEmpty():
                break
        if label is None:
            label = parent
        else:
            step = parent.select(F.col("u").alias("p"), F.col("p").alias("q"))
            label = materialize(label.join(step, "p", "left").select("u", F.coalesce("q", "p").alias("p")), "labels")
        root = lambda end: parent.select(F.col("u").alias(end), F.col("p").alias(f"{end}_root"))
        moved = live.join(root("hi"), "hi").join(root("lo"), "lo").select(*pair(F.col("hi_root"), F.col("lo_root"))).where("hi <> lo").distinct()
        live = materialize(moved, "links")
    if label is None:
        label = live.select(F.col("hi").alias("u"), F.col("lo").alias("p"))
    return label.select(F.col("u").alias("node"), F.col("p").alias("component"))
