"""Connected components of an edge table by repeated contraction, without a hub's edges ever in one task.

Each round every node takes the smallest label among itself and its neighbours; chains of labels are followed by
pointer jumping; edges are relabelled, made distinct and loops go. Labels of all nodes are composed at the end of a
round. Every round's tables are written to the shared folder. Joins are plain equi-joins of an edge table with a
table of one row per node, so adaptive execution can split a hub's edges over tasks; minima are pre-aggregated.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, new_path, remove


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of every node that an edge (a, b) touches: label is the smallest node of its component.

    Loops and repeated edges are allowed; edges with a null end are ignored; no edges give an empty result.
    """
    spark = edges.sparkSession
    store = lambda df, name: (df.write.parquet(path := new_path(spark, name)), (spark.read.schema(df.schema).parquet(path), path))[1]
    edges, edge_path = store(edges.filter("a is not null and b is not null and a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    labels = label_path = None
    while not edges.isEmpty():
        both = edges.select(F.col("a").alias("node"), F.col("b").alias("label")).union(edges.select(F.col("b").alias("node"), F.col("a").alias("label")))
        pointer, pointer_path = store(both.groupBy("node").agg(F.least("node", F.min("label")).alias("label")), "pointer")
        while True:
            up = pointer.select(F.col("node").alias("label"), F.col("label").alias("upper"))
            jumped, jumped_path = store(pointer.join(up, "label").select("node", F.col("upper").alias("label"), (F.col("upper") != F.col("label")).alias("moved")), "pointer")
            moved = not jumped.filter("moved").isEmpty()
            remove(spark, pointer_path)
            pointer, pointer_path = jumped.select("node", "label"), jumped_path
            if not moved:
                break
        if labels is None:
            labels, label_path = pointer, None
        else:
            up = pointer.select(F.col("node").alias("label"), F.col("label").alias("upper"))
            new, new_label_path = store(labels.join(up, "label", "left").select("node", F.coalesce("upper", "label").alias("label")), "labels")
            if label_path:
                remove(spark, label_path)
            labels, label_path = new, new_label_path
        ends = edges.join(pointer.select(F.col("node").alias("a"), F.col("label").alias("la")), "a").join(pointer.select(F.col("node").alias("b"), F.col("label").alias("lb")), "b")
        new, new_path_ = store(ends.filter("la <> lb").select(F.least("la", "lb").alias("a"), F.greatest("la", "lb").alias("b")).distinct(), "edges")
        remove(spark, edge_path)
        edges, edge_path = new, new_path_
    if labels is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("label"))
    return labels
