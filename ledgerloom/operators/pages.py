"""Pages of a catalog: one per workflow, with its chart, steps and cited lines, and pages of cards.

Pages are rows ``path, content`` that executors build and write (``inventory.write_tree``); none
is gathered.  What one page holds is bounded by its workflow, or by ``CARDS``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ledgerloom.functions.text import escape_html, fill, phase_label
from ledgerloom.operators import flow
from ledgerloom.operators.ranges import placed
from ledgerloom.operators.search import perspective_rank

#: Cards on one page.
CARDS = 500
STYLES = "body{font:16px sans-serif;margin:2em}svg{max-width:100%}.node{fill:#fff;stroke:#345}.line{fill:none;stroke:#789}mark{background:#ffd}"
#: What all pages share; values are HTML.
PAGE = """<!doctype html>
<html lang="en"><head><meta charset="utf-8"><title>{{title}}</title><style>{{styles}}</style></head>
<body><h1>{{title}}</h1>{{body}}</body></html>
"""


def page(title: Column, body: Column) -> Column:
    return fill(PAGE, title=escape_html(title), styles=F.lit(STYLES), body=body)


def _attributes(**values: Column) -> Column:
    return F.concat(*[part for name, value in values.items() for part in (F.lit(f' {name}="'), value.cast("string"), F.lit('"'))])


def node_shapes() -> Column:
    """A node (columns of :func:`flow.nodes`) as SVG."""
    x, y, w, h = (F.col(c) for c in "xywh")
    at = lambda *p: F.concat_ws(" ", *[F.concat_ws(",", a.cast("string"), b.cast("string")) for a, b in p])
    diamond = F.concat(F.lit('<polygon class="node"'), _attributes(points=at((x + w / 2, y), (x + w, y + h / 2), (x + w / 2, y + h), (x, y + h / 2))), F.lit("/>"))
    box = F.concat(F.lit('<rect class="node"'), _attributes(x=x, y=y, width=w, height=h), F.lit("/>"))
    label = F.concat(F.lit("<text"), _attributes(x=x + 12, y=y + 24), F.lit(">"), escape_html(F.col("display_number")), F.lit("</text>"))
    return F.concat(F.when(F.col("kind") == "decision", diamond).otherwise(box), label)


def charts(steps: DataFrame, layout: flow.Layout = flow.VERTICAL) -> DataFrame:
    """``workflow_id, nodes, svg``: each workflow's chart, nodes in drawing order before the lines between them."""
    shapes = flow.nodes(steps, layout)
    ends = F.col("points")
    line = F.concat(F.lit('<polyline class="line"'), _attributes(points=F.array_join(F.transform(ends, lambda p: F.concat_ws(",", p["x"].cast("string"), p["y"].cast("string"))), " ")), F.lit("/>"))
    zero = F.lit(0)
    drawn = shapes.select("workflow_id", F.struct(zero.alias("layer"), F.col("step").alias("a"), F.col("option").alias("b"), zero.alias("c"), zero.alias("d"), node_shapes().alias("text")).alias("part"))
    lines = flow.connectors(flow.edges(steps), shapes, layout)
    drawn = drawn.unionByName(lines.select("workflow_id", F.struct(F.lit(1).alias("layer"), F.col("from_step").alias("a"), F.col("from_option").alias("b"), F.col("to_step").alias("c"), F.col("to_option").alias("d"), line.alias("text")).alias("part")))
    parts = drawn.groupBy("workflow_id").agg(F.array_sort(F.collect_list("part")).alias("parts"), F.count_if(F.col("part.layer") == 0).alias("nodes"))  # one workflow's
    limits = flow.bounds(shapes).select("workflow_id", F.concat_ws(" ", *[c.cast("string") for c in (F.col("min_x"), F.col("min_y"), F.col("max_x") - F.col("min_x"), F.col("max_y") - F.col("min_y"))]).alias("box"))
    svg = F.concat(F.lit('<svg viewBox="'), F.col("box"), F.lit('">'), F.array_join(F.transform("parts", lambda p: p["text"]), ""), F.lit("</svg>"))
    return parts.join(limits, "workflow_id").select("workflow_id", "nodes", svg.alias("svg"))


def step_lists(steps: DataFrame) -> DataFrame:
    """``workflow_id, list``: each workflow's steps as an HTML list, ``steps (workflow_id, step, phase, title)``."""
    item = F.concat(F.lit("<li><b>"), escape_html(phase_label(F.col("phase"))), F.lit("</b> "), escape_html(F.col("title")), F.lit("</li>"))
    rows = steps.groupBy("workflow_id").agg(F.array_sort(F.collect_list(F.struct("step", item.alias("item")))).alias("items"))
    return rows.select("workflow_id", F.concat(F.lit("<ol>"), F.array_join(F.transform("items", lambda i: i["item"]), ""), F.lit("</ol>")).alias("list"))


def workflow_pages(titles: DataFrame, steps: DataFrame, folder: str = "workflows") -> DataFrame:
    """``path, content`` of a page per workflow: ``titles (workflow_id, title, status, summary)``, ``steps`` as of
    :func:`flow.steps_of` with ``phase``; a workflow without steps has a page without a chart."""
    rows = titles.join(charts(steps), "workflow_id", "left").join(step_lists(steps), "workflow_id", "left")
    body = F.concat(F.lit("<p>"), escape_html(F.col("status")), F.lit(": "), escape_html(F.col("summary")), F.lit("</p>"), F.coalesce("svg", F.lit("")), F.coalesce("list", F.lit("")))
    return rows.select(F.concat(F.lit(f"{folder}/"), F.col("workflow_id").cast("string"), F.lit(".html")).alias("path"), page(F.col("title"), body).alias("content"))


def card_pages(cards: DataFrame, folder: str = "workflows", many: int = CARDS) -> DataFrame:
    """``path, content`` of the pages of cards, ``many`` each, in order of ``area_place, at``.

    ``cards (workflow_id, title, status, summary, area_title, area_place, at)``; an area's title stands before its
    first card, and again on each page.  ``index.html`` is the first page.
    """
    numbered = placed(cards, [F.col("area_place").asc_nulls_last(), F.col("at").asc(), F.col("workflow_id").asc()], "place")
    card = F.concat(F.lit('<p><a href="'), F.lit(f"{folder}/"), escape_html(F.col("workflow_id").cast("string")), F.lit('.html">'), escape_html(F.col("title")), F.lit("</a> ("),
                    escape_html(F.col("status")), F.lit("): "), escape_html(F.col("summary")), F.lit("</p>"))
    rows = numbered.select(F.expr(f"(place - 1) div {many}").alias("page"), F.struct("place", F.coalesce("area_title", F.lit("Other")).alias("area"), card.alias("card")).alias("c"))
    lists = rows.groupBy("page").agg(F.array_sort(F.collect_list("c")).alias("cards"), F.lit(None).cast("string").alias("none"))  # ``many`` at most
    heading = lambda c, k: F.when((k == 0) | (c["area"] != F.get(F.col("cards"), k - 1)["area"]), F.concat(F.lit("<h2>"), escape_html(c["area"]), F.lit("</h2>"))).otherwise("")
    body = F.array_join(F.transform("cards", lambda c, k: F.concat(heading(c, k), c["card"])), "")
    after = F.concat(F.lit('<p><a href="page-'), (F.col("page") + 1).cast("string"), F.lit('.html">more</a></p>'))
    last = lists.agg(F.max("page").alias("last"))
    full = lists.crossJoin(F.broadcast(last))  # one row
    name = F.when(F.col("page") == 0, F.lit("index.html")).otherwise(F.concat(F.lit("page-"), F.col("page").cast("string"), F.lit(".html")))
    return full.select(name.alias("path"), page(F.lit("Catalog"), F.concat(body, F.when(F.col("page") < F.col("last"), after).otherwise(""))).alias("content"))


def site(areas: DataFrame, views: DataFrame) -> DataFrame:
    """``path, content`` of all pages of a catalog: ``areas`` and ``views`` of the read model."""
    titles = views.select(F.col("id").alias("workflow_id"), "title", "status", "summary", "area_id", "at")
    exploded = views.select(F.col("id").alias("workflow_id"), F.posexplode("steps").alias("step", "s"))
    steps = exploded.select("workflow_id", "step", "s.number", "s.title", "s.phase", F.col("s.options.title").alias("options"))
    order = placed(areas, [perspective_rank(F.col("perspective")).asc_nulls_last(), F.col("order").asc_nulls_last(), F.col("at").asc()], "area_place")
    order = order.groupBy("id").agg(F.max_by(F.struct("title", "area_place"), "at").alias("a")).select(F.col("id").alias("area_id"), F.col("a.title").alias("area_title"), "a.area_place")
    cards = titles.join(order, "area_id", "left")
    return workflow_pages(titles, steps).unionByName(card_pages(cards))
