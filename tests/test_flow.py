from __future__ import annotations

import ast

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import flow, health, locate

STEPS = [("w", 0, 1, "a", ["x", "y"]), ("w", 1, 2, "b", None), ("w", 2, 3, "c", ["p", "q", "r"]), ("v", 0, 1, "only", None)]


@pytest.fixture
def steps(spark):
    return spark.createDataFrame(STEPS, "workflow_id string, step int, number int, title string, options array<string>")


def test_edges_of_decisions(steps):
    rows = [tuple(r)[1:] for r in flow.edges(steps).where("workflow_id = 'w'").collect()]
    assert sorted(rows, key=str) == sorted([
        (0, -1, 0, 0, "x", True, False), (0, -1, 0, 1, "y", True, False), (0, 0, 1, -1, None, False, True), (0, 1, 1, -1, None, False, True),
        (1, -1, 2, -1, None, False, False), (2, -1, 2, 0, "p", True, False), (2, -1, 2, 1, "q", True, False), (2, -1, 2, 2, "r", True, False)], key=str)
    assert flow.edges(steps).where("workflow_id = 'v'").count() == 0


@pytest.mark.parametrize(("layout", "main", "options"), [
    (flow.VERTICAL, [(-105.0, 0.0), (-115.0, 452.0), (-105.0, 656.0)], [(-251.0, 220.0), (21.0, 220.0)]),
    (flow.HORIZONTAL, [(0.0, -63.0), (651.0, -56.0), (991.0, -63.0)], [(296.0, -129.0), (296.0, 17.0)]),
])
def test_layouts(steps, layout, main, options):
    rows = flow.nodes(steps, layout).where("workflow_id = 'w'").orderBy("step", "option").collect()
    assert [(r["x"], r["y"]) for r in rows if r["option"] < 0] == main
    assert [(r["x"], r["y"]) for r in rows if r["step"] == 0 and r["option"] >= 0] == options
    assert [r["display_number"] for r in rows] == ["1", "1.a", "1.b", "2", "3", "3.a", "3.b", "3.c"]


def test_hits_prefer_the_first_node_and_respect_diamonds(spark, steps):
    shapes = flow.nodes(steps, flow.VERTICAL)
    points = spark.createDataFrame([(1, "w", 0.0, 63.0), (2, "w", -104.0, 1.0), (3, "w", 0.0, 460.0), (4, "w", 900.0, 0.0)], "point_id int, workflow_id string, px double, py double")
    assert sorted(tuple(r) for r in flow.hits(points, shapes).collect()) == [(1, "w", 0, -1), (3, "w", 1, -1)]


def test_fit_clamps_the_scale(steps):
    limits = flow.bounds(flow.nodes(steps, flow.VERTICAL))
    scale = {r["workflow_id"]: r["scale"] for r in flow.fit(limits, 3000, 3000).collect()}
    assert scale["v"] == 1.15 and 0.3 <= flow.fit(limits, 10, 10).first()["scale"] <= 0.3


def test_relocation(spark):
    lines = "a\nb start\nc\nd other\n"
    rows = spark.createDataFrame([(0, "start", 2, 2), (1, "start", 3, 4), (2, "absent", 3, 3), (3, "", 1, 1), (4, "other", 9, 12)], "i int, symbol string, a int, b int")
    found = rows.withColumn("at", locate.relocated(F.split(F.lit(lines), "\n"), F.col("symbol"), F.col("a"), F.col("b"))).orderBy("i").select("at.*").collect()
    assert [tuple(r) for r in found] == [(2, 2, False), (2, 2, True), (3, 3, False), (1, 1, False), (4, 4, True)]


def test_health_findings(spark):
    long = "def f(a, b):\n" + "    x = 1\n" * 50 + "    return x\n"
    twisted = "async def g(a, b):\n" + "".join(f"    if a and b or {k}:\n        assert a\n" for k in range(6)) + "    with a:\n        return 1 if a else 2\n"
    nested = "def h():\n    def i():\n        for x in []:\n            pass\n"
    files = spark.createDataFrame([("a.py", long), ("b.py", twisted), ("c.py", "def (:\n"), ("d.py", "x\n" * 400), ("e.txt", "def (:\n"), ("n.py", nested), ("z.py", None)], "path string, content string")
    found = {(r["path"], r["metric"], r["name"], r["value"]) for r in health.health(files).collect()}
    assert found == {("a.py", "function_lines", "f", 52), ("b.py", "complexity", "g", 27), ("c.py", "syntax", None, None), ("d.py", "file_lines", None, 400), ("z.py", "unreadable", None, None)}
    assert {r["metric"]: r["findings"] for r in health.totals(health.health(files)).collect()}["syntax"] == 1


def test_arrow_heads_point_along_the_last_part(spark):
    points = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in ((0.0, 0.0), (10.0, 0.0))])
    head = spark.range(1).select(flow.arrow_head(points).alias("h")).first()["h"]
    assert [(round(p["x"], 3), round(p["y"], 3)) for p in head] == [(10.0, 0.0), (3.072, 4.0), (3.072, -4.0)]


def test_health_targets(spark):
    files = spark.createDataFrame([("src/a.py",), ("tests/b.py",), ("c.py",), ("srcs/d.py",)], "path string")
    paths = lambda *how: sorted(r["path"] for r in health.targeted(files, *how).collect())
    assert paths("src") == ["src/a.py"] and paths("/src/", True) == ["src/a.py", "tests/b.py"]
    assert paths("") == ["c.py", "src/a.py", "srcs/d.py"] and paths("", True) == ["c.py", "src/a.py", "srcs/d.py", "tests/b.py"]


def test_deep_trees_and_odd_lines_do_not_end_the_job(spark):
    deep = "x = " + "+".join(["a"] * 3000) + "\n"
    brackets = "x = " + "(" * 500 + ")" * 500 + "\n"
    feeds = "x = 1\x0c\n" * 399
    files = spark.createDataFrame([("deep.py", deep), ("brackets.py", brackets), ("feeds.py", feeds), ("nul.py", "a\0b")], "path string, content string")
    assert {(r["path"], r["metric"]) for r in health.health(files).collect()} == {("brackets.py", "syntax"), ("nul.py", "syntax")}


def test_equal_texts_are_parsed_once(monkeypatch):
    parsed = []
    parse = ast.parse
    monkeypatch.setattr(ast, "parse", lambda text, *how: parsed.append(text) or parse(text, *how))
    texts = [f"def same_{k}(x):\n" + "    x += 1\n" * 60 for k in range(3)] + ["def (:\n", "def same_4():\r\n    return\r"]
    limits = health.Limits()
    once = [list(health.findings_of(t, limits)) for t in texts]
    assert [list(health.findings_of(t, limits)) for t in texts * 50] == once * 50 and len(parsed) == len(texts)
    assert [f[2] for found in once for f in found] == ["function_lines"] * 3 + ["syntax"]
    # Other limits are another question about the same measures.
    assert [list(health.findings_of(t, health.Limits(1, 1, 0))) for t in texts][0] == [(None, None, "file_lines", 61, 1), (1, "same_0", "function_lines", 61, 1), (1, "same_0", "complexity", 1, 0)]


def test_what_is_kept_of_texts_is_bounded(monkeypatch):
    monkeypatch.setattr(health, "KEPT", 10)
    monkeypatch.setattr(health, "_known", {})
    for k in range(50):
        assert [f.name for f in health.measured(f"def f{k}(): pass\n").functions] == [f"f{k}"] and len(health._known) <= 10
    many = "".join(f"def f{k}(): pass\n" for k in range(health.KEPT_FUNCTIONS + 1))
    assert len(health.measured(many).functions) == len(health.measured(many).functions) == health.KEPT_FUNCTIONS + 1 and many not in health._known and len(health._known) <= 10


def test_branches_are_counted_wherever_they_stand():
    text = """
@d(1 if a else 2)
def f(a=b if c else d, *v: (x and y), k=(p or q)) -> (r if s else t):
    v[i if j else k].w = lambda z=(1 if 2 else 3): z and a and b
    with (o if p else q) as r, s: pass
    match (g if h else i):
        case {"k": [1, *rest], **more} if a or b: del u[a and b]
        case C(x=1) | (2 as y): x: (int or str) = f"{a if b else c!r:>{d or e}}"
    for x in (yield a or b): raise E(*[i for i in j if k and l], **{"a": m or n}) from (o and p)
    try: pass
    except (A if B else C) as e: assert a, (b or c)
    type T[U: (a or b)] = int
    class D((a or b), metaclass=(c if d else e)):
        x = a < (b and c) < d
        async def g(self): return await (a or b)
    print(-(a or b), not (a and b), a[b or c : d : e if f else g], {a: b or c}, {**(d or e)}, (h := i or j))
"""
    tree = ast.parse(text)
    # By brute force over all nodes below.
    cost = lambda f: 1 + sum(len(n.values) - 1 if type(n) is ast.BoolOp else health._COST.get(type(n), 0) for n in ast.walk(f))
    plain = {(n.name, n.lineno): cost(n) for n in ast.walk(tree) if isinstance(n, ast.FunctionDef | ast.AsyncFunctionDef)}
    assert {(f.name, f.line): f.complexity for f in health.functions_of(tree)} == plain and min(plain.values()) == 2 and max(plain.values()) == 39
