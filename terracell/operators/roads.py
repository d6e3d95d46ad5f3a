"""Road graphs: segments, lengths, filters, degrees, summaries, contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terracell.functions import quad
from terracell.functions.geo import class_penalty, class_rank, haversine
from terracell.operators.components import components
from terracell.session import cut

MAINLINE = ("motorway", "trunk", "primary", "secondary")


def shared_nodes(ways: DataFrame) -> DataFrame:
    """ref, ways: nodes (way_id, refs) that more than one way has."""
    refs = ways.select(F.explode(F.array_distinct("refs")).alias("ref"))
    return refs.groupBy("ref").agg(F.count(F.lit(1)).alias("ways")).where("ways > 1")


def segments(ways: DataFrame, shared: DataFrame) -> DataFrame:
    """way_id, segment, u, v, n_refs: ways cut at shared nodes and at both ends."""
    refs = ways.select("way_id", F.size("refs").alias("n"), F.posexplode("refs").alias("pos", "ref"))
    marked = refs.join(shared.select("ref", F.lit(True).alias("shared")), "ref", "left")
    split = F.coalesce(F.col("shared"), F.lit(False)) | (F.col("pos") == 0) | (F.col("pos") == F.col("n") - 1)
    w = Window.partitionBy("way_id").orderBy("pos")
    ends = marked.where(split).withColumns({"v": F.lead("ref").over(w), "to": F.lead("pos").over(w), "segment": F.row_number().over(w) - 1})
    return ends.where("v is not null").select("way_id", "segment", F.col("ref").alias("u"), "v", (F.col("to") - F.col("pos") + 1).alias("n_refs"))


def lengths(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with length_m and cost (length times the class's penalty)."""
    a, b = (nodes.selectExpr(f"node_id as {k}", f"lat as {k}_lat", f"lon as {k}_lon") for k in ("u", "v"))
    rows = edges.join(a, "u").join(b, "v").withColumn("length_m", haversine(F.col("u_lat"), F.col("u_lon"), F.col("v_lat"), F.col("v_lon")))
    return rows.withColumn("cost", F.col("length_m") * class_penalty(F.col("road_class"))).drop("u_lat", "u_lon", "v_lat", "v_lon")


def parallel_min(edges: DataFrame, length: str) -> DataFrame:
    return edges.groupBy(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).agg(F.min(length).alias(length))


def degrees(edges: DataFrame) -> DataFrame:
    """node, degree: ends of edges, parallel ones and both ends of loops included."""
    return edges.select(F.explode(F.array("u", "v")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("degree"))


def cross_cell(edges: DataFrame, nodes: DataFrame, res: int) -> DataFrame:
    cells = nodes.select("node_id", quad.cell(F.col("lat"), F.col("lon"), res).alias("cell"))
    a, b = cells.toDF("u", "u_cell"), cells.toDF("v", "v_cell")
    return edges.join(a, "u").join(b, "v").where("u_cell <> v_cell").select("u", "v", "road_class", "u_cell", "v_cell")


def mainline(edges: DataFrame) -> DataFrame:
    return edges.where(F.col("road_class").isin(*MAINLINE))


def best_rank(edges: DataFrame, nodes: DataFrame, res: int) -> DataFrame:
    """cell, best, worst class rank of the edges that start in it."""
    cells = nodes.select(F.col("node_id").alias("u"), quad.cell(F.col("lat"), F.col("lon"), res).alias("cell"))
    rank = class_rank(F.col("road_class"))
    return edges.join(cells, "u").groupBy("cell").agg(F.min(rank).alias("best"), F.max(rank).alias("worst"))


def summary(edges: DataFrame) -> DataFrame:
    """One row: edges, nodes, components, nodes of two and of three or more distinct neighbours."""
    pairs = edges.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
    near = degrees(pairs).agg(F.count_if(F.col("degree") == 2).alias("two"), F.count_if(F.col("degree") >= 3).alias("branch"))
    found = components(edges)
    return edges.agg(F.count(F.lit(1)).alias("edges")).join(found.agg(F.count(F.lit(1)).alias("nodes"), F.count_distinct("component").alias("components"))).join(near)  # one row each


def contract(edges: DataFrame, protected: DataFrame | None = None, total: str | None = None) -> DataFrame:
    """u, v, road_class, parts (and the sum of a column `total`): chains of nodes of degree two become one edge.

    A node is inside a chain if it is not protected and has just two edges, of one class, to two different neighbours; that set doesn't change while
    chains shrink, so edges that share such a node are labelled together and each label's ends are kept.  A ring without any other node keeps its
    two largest; a loop at a junction keeps the junction and its largest node."""
    e = cut(edges.where("u <> v").select("u", "v", "road_class", (F.col(total) if total else F.lit(0.0)).alias("total"), F.monotonically_increasing_id().alias("id")))
    ends = e.select("id", "road_class", "total", F.col("u").alias("node"), F.col("v").alias("other")).union(e.select("id", "road_class", "total", "v", "u"))
    inner = ends.groupBy("node").agg(F.count(F.lit(1)).alias("degree"), F.min("road_class").alias("a"), F.max("road_class").alias("b"), F.count_distinct("other").alias("others"))
    inner = inner.where("degree = 2 and a = b and others = 2").select("node")
    if protected is not None:
        inner = inner.join(protected, "node", "left_anti")
    chained = ends.join(inner, "node", "left_semi").groupBy("node").agg(F.min("id").alias("u"), F.max("id").alias("v"))
    labels = components(chained.select("u", "v")).toDF("id", "label")
    marked = cut(ends.join(labels, "id", "left").withColumn("label", F.coalesce("label", "id")).join(inner.withColumn("inner", F.lit(True)), "node", "left"))
    outer = marked.where("inner is null").groupBy("label").agg(F.sort_array(F.collect_list("node")).alias("outer"))  # two at most
    whole = marked.groupBy("label").agg(F.min("road_class").alias("road_class"), (F.count(F.lit(1)) / 2).cast("long").alias("parts"), (F.sum("total") / 2).alias("total"), F.max(F.when(F.col("inner"), F.col("node"))).alias("top"))
    second = marked.where("inner").join(whole.select("label", "top"), "label").where("node < top").groupBy("label").agg(F.max("node").alias("second"))
    rows = whole.join(outer, "label", "left").join(second, "label", "left")
    ring, loop = F.col("outer").isNull(), F.col("outer")[0] == F.get("outer", F.lit(1))
    u = F.when(ring, F.col("second")).when(loop, F.least(F.col("outer")[0], "top")).otherwise(F.col("outer")[0])
    v = F.when(ring, F.col("top")).when(loop, F.greatest(F.col("outer")[0], "top")).otherwise(F.col("outer")[1])
    more = [F.col("total").alias(total)] if total else []
    out = rows.select(u.alias("u"), v.alias("v"), "road_class", "parts", *more, (ring | loop).alias("two"))
    # a ring or loop is two edges between the nodes that it keeps; each has the whole one's parts and total
    return out.select("u", "v", "road_class", "parts", *([total] if total else []), F.explode(F.when(F.col("two"), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy")).drop("copy")
