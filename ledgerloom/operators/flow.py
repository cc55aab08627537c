"""Flowcharts as tables: nodes, edges, layouts, hit tests and view fitting.

A step without options is a process; one with options is a decision whose options
are laid out beside each other.  Positions along the main axis are running sums
over a workflow's earlier steps.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from ledgerloom.functions.text import clamp

PROCESS_W, PROCESS_H = 230.0, 112.0


@dataclass(frozen=True)
class Layout:
    """Sizes and gaps of one direction; ``along`` is the main axis."""

    vertical: bool
    decision_w: float
    decision_h: float
    step_gap: float
    branch_gap: float
    merge_gap: float
    option_gap: float

    @property
    def process_advance(self) -> float:
        return (PROCESS_H if self.vertical else PROCESS_W) + self.step_gap

    @property
    def option_shift(self) -> float:
        return (self.decision_h if self.vertical else self.decision_w) + self.branch_gap

    @property
    def decision_advance(self) -> float:
        return self.option_shift + (PROCESS_H if self.vertical else PROCESS_W) + self.merge_gap


# Fixed values of the two layouts.
VERTICAL = Layout(True, 210.0, 126.0, 92.0, 94.0, 120.0, 42.0)
HORIZONTAL = Layout(False, 190.0, 126.0, 110.0, 106.0, 125.0, 34.0)


def steps_of(views: DataFrame) -> DataFrame:
    """``workflow_id, step, number, title, options (titles)`` of workflow views."""
    rows = views.select(F.col("id").alias("workflow_id"), F.posexplode("steps").alias("step", "s"))
    return rows.select("workflow_id", "step", "s.number", "s.title", F.col("s.options.title").alias("options"))


def nodes(steps: DataFrame, layout: Layout) -> DataFrame:
    """``workflow_id, step, option, kind, display_number, x, y, w, h``; option is -1 for a step's own node.

    ``steps (workflow_id, step, number, options)``, step counting from 0.
    """
    count = F.coalesce(F.size("options"), F.lit(0))
    decides = count > 0
    advance = F.when(decides, layout.decision_advance).otherwise(layout.process_advance)
    before = Window.partitionBy("workflow_id").orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    placed = steps.withColumn("along", F.coalesce(F.sum(advance).over(before), F.lit(0.0)))
    placed = placed.select("workflow_id", "step", "number", "along", count.alias("n"), F.when(decides, F.sequence(F.lit(-1), count - 1)).otherwise(F.array(F.lit(-1))).alias("each"))
    rows = placed.select("*", F.explode("each").alias("option"))
    main = F.col("option") < 0
    decision = main & (F.col("n") > 0)
    w, h = F.when(decision, layout.decision_w).otherwise(PROCESS_W), F.when(decision, layout.decision_h).otherwise(PROCESS_H)
    side = PROCESS_W if layout.vertical else PROCESS_H
    spread = F.col("n") * side + (F.col("n") - 1) * layout.option_gap
    across = F.when(main, -(w if layout.vertical else h) / 2).otherwise(-spread / 2 + F.col("option") * (side + layout.option_gap))
    along = F.col("along") + F.when(main, 0.0).otherwise(layout.option_shift)
    x, y = (across, along) if layout.vertical else (along, across)
    number = F.when(main, F.col("number").cast("string")).otherwise(F.concat_ws(".", F.col("number").cast("string"), F.char(97 + F.col("option"))))
    return rows.select("workflow_id", "step", "option", F.when(decision, "decision").otherwise("process").alias("kind"), number.alias("display_number"),
                       x.alias("x"), y.alias("y"), w.alias("w"), h.alias("h"))


def edges(steps: DataFrame) -> DataFrame:
    """``workflow_id, from_step, from_option, to_step, to_option, label, branch, merge``."""
    following = F.lead("step").over(Window.partitionBy("workflow_id").orderBy("step"))
    rows = steps.select("workflow_id", "step", "options", following.alias("next"))
    decides = F.coalesce(F.size("options"), F.lit(0)) > 0
    edge = lambda a, i, b, j, label, branch, merge: (F.col("workflow_id"), a.alias("from_step"), i.alias("from_option"), b.alias("to_step"), j.alias("to_option"), label.alias("label"), F.lit(branch).alias("branch"), F.lit(merge).alias("merge"))
    none, text = F.lit(-1), F.lit(None).cast("string")
    plain = rows.where(~decides & F.col("next").isNotNull()).select(*edge(F.col("step"), none, F.col("next"), none, text, False, False))
    options = rows.where(decides).select("workflow_id", "step", "next", F.posexplode("options").alias("option", "title"))
    branches = options.select(*edge(F.col("step"), none, F.col("step"), F.col("option"), F.col("title"), True, False))
    merges = options.where("next is not null").select(*edge(F.col("step"), F.col("option"), F.col("next"), none, text, False, True))
    return branches.unionByName(merges).unionByName(plain)


def contains(x: Column, y: Column) -> Column:
    """Whether a node (columns ``kind, x, y, w, h``) covers a point."""
    box = x.between(F.col("x"), F.col("x") + F.col("w")) & y.between(F.col("y"), F.col("y") + F.col("h"))
    half_w, half_h = F.col("w") / 2, F.col("h") / 2
    diamond = F.abs(x - (F.col("x") + half_w)) / half_w + F.abs(y - (F.col("y") + half_h)) / half_h <= 1
    return F.when(F.col("kind") == "decision", diamond).otherwise(box)


#: Cells of the finest grid: no shape of a layout is larger.
CELL_W, CELL_H = PROCESS_W, 126.0


def _level(w: Column, h: Column) -> Column:
    """The grid, of cells twice as large each, in which a shape covers four cells at most."""
    larger = F.greatest(w / CELL_W, h / CELL_H, F.lit(1.0))
    level = F.ceil(F.log2(larger)).cast("int")
    return F.when(F.pow(F.lit(2.0), level) < larger, level + 1).otherwise(level)


def near_shapes(points: DataFrame, shapes: DataFrame) -> DataFrame:
    """``points`` with each shape of their chart that shares a grid cell with them."""
    scale = F.pow(F.lit(2.0), F.col("level"))
    cell = lambda at, size: F.floor(at / (size * scale)).cast("long")
    over = lambda low, high, size: F.explode(F.sequence(cell(low, size), cell(high, size)))
    levelled = shapes.where("x is not null and y is not null and w >= 0 and h >= 0").withColumn("level", _level(F.col("w"), F.col("h")))
    # A row per size of shapes, doubling: a few dozen at most.
    levels = F.broadcast(levelled.select("level").distinct())
    dealt = levelled.withColumn("cell_x", over(F.col("x"), F.col("x") + F.col("w"), CELL_W)).withColumn("cell_y", over(F.col("y"), F.col("y") + F.col("h"), CELL_H))
    asked = points.crossJoin(levels).withColumn("cell_x", cell(F.col("px"), CELL_W)).withColumn("cell_y", cell(F.col("py"), CELL_H))
    return asked.join(dealt, ["workflow_id", "level", "cell_x", "cell_y"]).drop("level", "cell_x", "cell_y")


def hits(points: DataFrame, shapes: DataFrame) -> DataFrame:
    """``point_id`` with the first node, in drawing order, that covers it.

    ``points (point_id, workflow_id, px, py)``: a point is tested on its own workflow's chart, against the
    shapes in its grid cells, however many the chart has.
    """
    met = near_shapes(points, shapes).where(contains(F.col("px"), F.col("py")))
    return met.groupBy("point_id", "workflow_id").agg(F.min(F.struct("step", "option")).alias("hit")).select("point_id", "workflow_id", "hit.step", "hit.option")


def bounds(shapes: DataFrame) -> DataFrame:
    """``workflow_id, min_x, max_x, min_y, max_y`` of each chart."""
    return shapes.groupBy("workflow_id").agg(F.min("x").alias("min_x"), F.max(F.col("x") + F.col("w")).alias("max_x"), F.min("y").alias("min_y"), F.max(F.col("y") + F.col("h")).alias("max_y"))


def fit(limits: DataFrame, width: float, height: float) -> DataFrame:
    """``workflow_id, scale, x, y`` that shows each chart whole in a viewport."""
    top, low, high = 170.0, 0.3, 1.15
    w = F.greatest(F.lit(PROCESS_W), F.col("max_x") - F.col("min_x"))
    h = F.greatest(F.lit(PROCESS_H), F.col("max_y") - F.col("min_y"))
    room_w, room_h = max(1.0, width - 100), max(1.0, height - top - 70)
    scale = clamp(F.least(F.lit(room_w) / w, F.lit(room_h) / h), low, high)
    rows = limits.withColumn("scale", scale)
    return rows.select("workflow_id", "scale", ((F.lit(width) - w * F.col("scale")) / 2 - F.col("min_x") * F.col("scale")).alias("x"),
                       (F.lit(top) + (F.lit(room_h) - h * F.col("scale")) / 2 - F.col("min_y") * F.col("scale")).alias("y"))


def first_view(shapes: DataFrame, width: float, header_bottom: float = 0.0, scale: float = 0.5) -> DataFrame:
    """``workflow_id, scale, x, y`` that shows each chart's first node below the header."""
    first = shapes.groupBy("workflow_id").agg(F.min_by(F.struct("x", "y", "w"), F.struct("step", "option")).alias("f"))
    top = max(170.0, header_bottom + 32)
    return first.select("workflow_id", F.lit(scale).alias("scale"), (F.lit(width / 2) - (F.col("f.x") + F.col("f.w") / 2) * scale).alias("x"), (F.lit(top) - F.col("f.y") * scale).alias("y"))


def anchor(node: Column, side: str) -> Column:
    """The middle of a node's side."""
    fx, fy = {"top": (0.5, 0.0), "bottom": (0.5, 1.0), "left": (0.0, 0.5), "right": (1.0, 0.5)}[side]
    return F.struct((node["x"] + node["w"] * fx).alias("x"), (node["y"] + node["h"] * fy).alias("y"))


def connectors(links: DataFrame, shapes: DataFrame, layout: Layout) -> DataFrame:
    """``links`` with ``points``, the four corners of each edge's line."""
    box = F.struct("x", "y", "w", "h")
    named = lambda end: shapes.select("workflow_id", F.col("step").alias(f"{end}_step"), F.col("option").alias(f"{end}_option"), box.alias(f"{end}_box"))
    rows = links.join(named("from"), ["workflow_id", "from_step", "from_option"]).join(named("to"), ["workflow_id", "to_step", "to_option"])
    a, b = anchor(F.col("from_box"), "bottom" if layout.vertical else "right"), anchor(F.col("to_box"), "top" if layout.vertical else "left")
    bend = (a["y"] + b["y"]) / 2 if layout.vertical else (a["x"] + b["x"]) / 2
    point = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    corners = (point(a["x"], bend), point(b["x"], bend)) if layout.vertical else (point(bend, a["y"]), point(bend, b["y"]))
    return rows.select(*links.columns, F.array(a, *corners, b).alias("points"))


def arrow_head(points: Column, size: float = 8.0, spread: float = math.pi / 6) -> Column:
    """The three corners of the arrow at the end of a line: its tip, and behind it to either side."""
    tip, before = F.element_at(points, -1), F.element_at(points, -2)
    angle = F.atan2(tip["y"] - before["y"], tip["x"] - before["x"])
    behind = lambda a: F.struct((tip["x"] - size * F.cos(a)).alias("x"), (tip["y"] - size * F.sin(a)).alias("y"))
    return F.array(F.struct(tip["x"].alias("x"), tip["y"].alias("y")), behind(angle - spread), behind(angle + spread))


def canvas_point(px: Column, py: Column, x: Column, y: Column, scale: Column) -> Column:
    """A screen point in chart coordinates."""
    return F.struct(((px - x) / scale).alias("x"), ((py - y) / scale).alias("y"))
