"""Boxes of text and shapes on a frame: what leaves it, what crosses, what fits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EDGE, TOUCH, INSIDE, VISIBLE = 0.05, 0.05, 0.02, 0.05


def visible(boxes: DataFrame) -> DataFrame:
    """Boxes whose opacity can be seen."""
    return boxes.where(F.col("opacity") >= VISIBLE)


def box_problems(boxes: DataFrame, width: float, height: float, caption_share: float = 0.15) -> DataFrame:
    """frame, id, problem of boxes(frame, id, x0, y0, x1, y1), the middle being 0: what leaves the frame, else what covers the caption area."""
    w, h = width / 2 + EDGE, height / 2 + EDGE
    leaves = (F.col("x0") < -w) | (F.col("x1") > w) | (F.col("y1") > h) | (F.col("y0") < -h)
    covers = F.col("y0") < -height / 2 + height * caption_share - EDGE
    return boxes.select("frame", "id", F.when(leaves, "leaves the screen").when(covers, "covers the subtitle area").alias("problem")).where("problem is not null")


def crossed(texts: DataFrame, points: DataFrame, shapes: DataFrame) -> DataFrame:
    """frame, id of texts(frame, id, x0, y0, x1, y1) that a point of an outline touches, points(frame, shape, x, y), unless the shape(frame,
    shape, x0, y0, x1, y1) contains the text."""
    t = texts.alias("t")
    near = t.join(
        points.alias("p"),
        (F.col("t.frame") == F.col("p.frame")) & (F.col("p.x") > F.col("t.x0") - TOUCH) & (F.col("p.x") < F.col("t.x1") + TOUCH) & (F.col("p.y") > F.col("t.y0") - TOUCH) & (F.col("p.y") < F.col("t.y1") + TOUCH),
    ).select("t.frame", "t.id", "t.x0", "t.y0", "t.x1", "t.y1", "p.shape").distinct().alias("n")
    s = shapes.alias("s")
    contains = (F.col("s.x0") <= F.col("n.x0") + INSIDE) & (F.col("s.x1") >= F.col("n.x1") - INSIDE) & (F.col("s.y0") <= F.col("n.y0") + INSIDE) & (F.col("s.y1") >= F.col("n.y1") - INSIDE)
    return near.join(s, (F.col("n.frame") == F.col("s.frame")) & (F.col("n.shape") == F.col("s.shape"))).where(~contains).select("n.frame", "n.id").distinct()


def fitted(width: Column, height: Column, x: Column, y: Column, most_width: float, most_height: float) -> Column:
    """struct(scale, x, y): a box made smaller where it is too large, then moved inside."""
    scale = F.least(F.lit(1.0), most_width / width, most_height / height)
    inside = lambda c, size, most: F.greatest(-most / 2 + size * scale / 2, F.least(most / 2 - size * scale / 2, c))
    return F.struct(F.round(scale, 6).alias("scale"), F.round(inside(x, width, most_width), 6).alias("x"), F.round(inside(y, height, most_height), 6).alias("y"))


def mode(visual_type: Column, layout: Column) -> Column:
    """comparison, text or connected, by a scene's type and the words of its layout."""
    kind, words = F.lower(F.trim(F.coalesce(visual_type, F.lit("")))), F.lower(F.trim(F.coalesce(layout, F.lit(""))))
    has = lambda *some: F.greatest(*(F.contains(words, F.lit(s)).cast("int") for s in some)) == 1
    return (
        F.when((kind == "comparison") | has("comparison", "side-by-side", "versus", "vs"), "comparison")
        .when((kind == "text") | F.contains(words, F.lit("title card")) | (words == "centered text"), "text")
        .when(kind.isin("diagram", "process", "animation", "mixed", "chart", "timeline", "graph") | has("flow", "process", "left-to-right", "left to right", "diagram"), "connected")
        .otherwise("text")
    )


def reference_problems(elements: DataFrame, references: DataFrame) -> DataFrame:
    """scene, kind, target of references(scene, kind, target) to elements(scene, id) that aren't there."""
    return references.join(elements.select("scene", F.col("id").alias("target")).distinct(), ["scene", "target"], "left_anti").select("scene", "kind", "target").distinct()


def action_problems(actions: DataFrame) -> DataFrame:
    """scene, problem of actions(scene, action_order, targets): an order that two have, or no target."""
    g = actions.groupBy("scene").agg((F.count("*") != F.count_distinct("action_order")).alias("twice"), F.max((F.coalesce(F.size("targets"), F.lit(0)) <= 0).cast("int")).alias("bare"))
    return g.select("scene", F.explode(F.array_compact(F.array(F.when(F.col("twice"), "order twice"), F.when(F.col("bare") == 1, "no target")))).alias("problem"))
