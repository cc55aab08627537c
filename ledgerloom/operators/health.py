"""Code health of Python sources: file length, function length and complexity.

One Arrow pass parses each text once and walks its tree once.  Sources hold many equal texts (copied modules,
empty package files): a Python worker keeps what it measured of the last ``KEPT`` texts by their digests.
"""

from __future__ import annotations

import ast
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

# A file fails at so many lines, a function beyond so many and beyond so much complexity.
FILE_LINES, FUNCTION_LINES, COMPLEXITY = 400, 50, 15
# What each kind of node adds to the complexity; a boolean operator adds one for each operand but the first.
_COST = dict.fromkeys((ast.If, ast.While, ast.For, ast.AsyncFor, ast.ExceptHandler, ast.With, ast.AsyncWith, ast.IfExp, ast.Assert), 1)
#: Texts whose measures a worker keeps, each of at most so many functions: some 10 MB.
KEPT, KEPT_FUNCTIONS = 4_096, 8
# Fields of nodes that hold names, constants, operators or contexts, and nodes without others: nothing below them is counted.
_PLAIN = {"arg", "asname", "attr", "conversion", "ctx", "id", "is_async", "kind", "kwd_attrs", "level", "module", "names", "op", "ops", "rest", "simple", "tag", "type_comment", "type_ignores"}
_LEAVES = frozenset((ast.Name, ast.Constant, ast.Pass, ast.Break, ast.Continue, ast.Import, ast.ImportFrom, ast.Global, ast.Nonlocal, ast.MatchSingleton))
_FINDING = "path string, line int, name string, metric string, value int, limit int"


@dataclass(frozen=True)
class Limits:
    file_lines: int = FILE_LINES
    function_lines: int = FUNCTION_LINES
    complexity: int = COMPLEXITY


@dataclass
class Function:
    """What was measured of one function; ``outer`` is the place of the function around it."""

    line: int
    name: str
    lines: int
    complexity: int
    outer: int | None


def _fields(kind: type[ast.AST]) -> tuple[str, ...]:
    """The fields of a kind of node below which something may be counted; a name is no such field unless it is a node."""
    return tuple(f for f in kind._fields if f not in _PLAIN and not (f == "name" and kind is not ast.TypeAlias))


def functions_of(tree: ast.AST) -> list[Function]:
    """All functions of a tree; a function's complexity includes the definitions in it."""
    found: list[Function] = []
    below: dict[type, tuple[str, ...]] = {}
    waiting: list[tuple[ast.AST, int | None]] = [(tree, None)]
    while waiting:
        node, around = waiting.pop()
        kind = type(node)
        if kind is ast.FunctionDef or kind is ast.AsyncFunctionDef:
            found.append(Function(node.lineno, node.name, (node.end_lineno or node.lineno) - node.lineno + 1, 1, around))
            around = len(found) - 1
        elif around is not None:
            found[around].complexity += len(node.values) - 1 if kind is ast.BoolOp else _COST.get(kind, 0)
        fields = below.get(kind)
        if fields is None:
            fields = below[kind] = _fields(kind)
        for field in fields:
            child = getattr(node, field, None)
            if type(child) is list:
                waiting += [(c, around) for c in child if c is not None and type(c) not in _LEAVES]
            elif child is not None and type(child) not in _LEAVES:
                waiting.append((child, around))
    # Inner functions are found after the ones around them: from the last on, each hands its forks out.
    for inner in reversed(found):
        if inner.outer is not None:
            found[inner.outer].complexity += inner.complexity - 1
    return found


@dataclass(frozen=True)
class Measures:
    """A text's lines and functions; of one that does not parse, where it fails."""

    lines: int
    functions: list[Function]
    parses: bool = True
    line: int | None = None


_known: dict[bytes, Measures] = {}


def _parsed(text: str) -> Measures:
    text = text.replace("\r\n", "\n").replace("\r", "\n")
    lines = text.count("\n") + (text != "" and not text.endswith("\n"))
    try:
        return Measures(lines, functions_of(ast.parse(text)))
    except (SyntaxError, ValueError, RecursionError, MemoryError) as error:
        return Measures(lines, [], False, getattr(error, "lineno", None))


def measured(text: str) -> Measures:
    """What is measured of a text; of an equal one that this worker has met lately, what was measured then."""
    digest = hashlib.sha256(text.encode("utf-8", "surrogatepass")).digest()
    if digest in _known:
        return _known[digest]
    measures = _parsed(text)
    if len(measures.functions) <= KEPT_FUNCTIONS:
        if len(_known) >= KEPT:
            del _known[next(iter(_known))]
        _known[digest] = measures
    return measures


def findings_of(text: str | None, limits: Limits) -> Iterator[tuple]:
    """``line, name, metric, value, limit`` of everything over a limit."""
    if text is None:
        yield None, None, "unreadable", None, None
        return
    measures = measured(text)
    if not measures.parses:
        yield measures.line, None, "syntax", None, None
        return
    if measures.lines >= limits.file_lines:
        yield None, None, "file_lines", measures.lines, limits.file_lines
    for found in measures.functions:
        if found.lines > limits.function_lines:
            yield found.line, found.name, "function_lines", found.lines, limits.function_lines
        if found.complexity > limits.complexity:
            yield found.line, found.name, "complexity", found.complexity, limits.complexity


def health(files: DataFrame, content: str = "content", limits: Limits = Limits()) -> DataFrame:
    """``path, line, name, metric, value, limit`` of Python ``files (path, content)``."""
    kinds = [pa.string(), pa.int32(), pa.string(), pa.string(), pa.int32(), pa.int32()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows = [(path, *found) for path, text in zip(part.column("path").to_pylist(), part.column("text").to_pylist(), strict=True) for found in findings_of(text, limits)]
                columns = list(zip(*rows)) if rows else [[]] * len(kinds)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["path", "line", "name", "metric", "value", "limit"])

    rows = files.where(F.endswith("path", F.lit(".py"))).select("path", F.col(content).cast("string").alias("text"))
    return rows.mapInArrow(run, _FINDING)


def complexities(files: DataFrame, content: str = "content") -> DataFrame:
    """``path, line, name, lines, complexity`` of every function of Python ``files``; texts that do not parse have none."""

    kinds = [pa.string(), pa.int32(), pa.string(), pa.int32(), pa.int32()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(path, f.line, f.name, f.lines, f.complexity) for path, text in zip(batch.column("path").to_pylist(), batch.column("text").to_pylist(), strict=True) for f in measured(text or "").functions]
            columns = list(zip(*rows)) if rows else [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["path", "line", "name", "lines", "complexity"])

    rows = files.where(F.endswith("path", F.lit(".py"))).select("path", F.col(content).cast("string").alias("text"))
    return rows.mapInArrow(run, "path string, line int, name string, lines int, complexity int")


def targeted(files: DataFrame, folder: str, tests: bool = False, tests_folder: str = "tests") -> DataFrame:
    """``files`` below a folder (below any, if it is empty), and those of the tests where these are asked for."""
    inside = F.lit(True) if not folder.strip("/") else F.startswith("path", F.lit(folder.strip("/") + "/"))
    of_tests = F.startswith("path", F.lit(tests_folder + "/"))
    return files.where((inside & ~of_tests if not folder.strip("/") else inside) | (of_tests if tests else F.lit(False)))


def totals(findings: DataFrame) -> DataFrame:
    """``metric, findings`` and whether any file or function fails."""
    return findings.groupBy("metric").agg(F.count("*").alias("findings"))
