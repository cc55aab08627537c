from __future__ import annotations

import io
import os.path

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import paths, text


def values(spark, expression, given):
    rows = spark.createDataFrame(list(enumerate(given)), "i int, v string")
    return [r[0] for r in rows.orderBy("i").select(expression(F.col("v"))).collect()]


def test_strip_removes_all_white_space(spark):
    given = ["  a ", " b ", "\x85c\x1c", "\t\n", "", "d e", "\x0bf\x0c", None]
    assert values(spark, text.strip, given) == [(v or "").strip() for v in given]


def test_normalize_path_like_a_relative_path(spark):
    given = ["a/b", "./a", "a/../b", "../x", "a//b", "a/./b", "a/b/..", "..", ".", "a/../../b", "x/", "../../y", "a\\b"]
    assert values(spark, text.normalize_path, given) == [os.path.normpath(v.replace("\\", "/")) for v in given]


def test_suffix_like_splitext(spark):
    given = ["a.py", "A.PY", ".gitignore", "..x", "a.tar.gz", "dir.d/file", "x.", "", ".a.b", "a/b/.c", "...", "n\n.x"]
    assert values(spark, text.suffix, given) == [os.path.splitext(v)[1].lower() for v in given]


def test_line_count_uses_universal_newlines(spark):
    given = ["", "a", "a\n", "a\nb", "a\r\nb\r\n", "a\rb", "\n", "\r\n\r\n", "a\n\rb", "a\r\n\nb\r"]
    assert values(spark, text.line_count, given) == [sum(1 for _ in io.StringIO(v, newline=None)) for v in given]


def test_labels_and_escapes(spark):
    assert values(spark, text.phase_label, ["user_action", "ui_update_now", "backend"]) == ["USER ACTION", "UI UPDATE_NOW", "BACKEND"]
    assert values(spark, text.escape_html, ["<a b=\"c\">'&amp;", None]) == ["&lt;a b=&quot;c&quot;&gt;&#39;&amp;amp;", ""]
    assert values(spark, text.json_for_script, ['{"a":"</script><!--"}']) == ['{"a":"<\\/script><\\!--"}']
    assert values(spark, text.trim_slashes, ["/a/b/", "//"]) == ["a/b", ""]
    assert values(spark, lambda c: text.counted(c.cast("int"), "line", "lines"), ["1", "2"]) == ["1 line", "2 lines"]


@pytest.mark.parametrize(("existing", "expected"), [
    ("", "B\nx\nE\n"), ("a", "a\n\nB\nx\nE\n"), ("a\n", "a\n\nB\nx\nE\n"),
    ("a\nB\nold\nE\n\n\nz", "a\nB\nx\nE\nz"), ("E\nB\n", "E\nB\n\nB\nx\nE\n"),
])
def test_managed_block(spark, existing, expected):
    assert values(spark, lambda c: text.upsert_block(c, F.lit(" x\n"), "B", "E"), [existing]) == [expected]


def test_allowed_paths_keep_root_level_dot_directories_when_listed(spark):
    given = [".git/a", "x/.git/a", "node_modules/a.js", "a.png", "A.PNG", ".next/a", "x/.next/a", "src/a.py", "x.egg-info/a", "build", "", ".venv/q.py", "./dist/a"]
    assert values(spark, paths.allowed_path, given) == [True, False, False, False, False, True, False, True, False, True, False, False, False]


def test_language_defaults_to_plain(spark):
    assert values(spark, paths.language, ["a.py", "b.TSX", "c.hpp", "Makefile", "d.unknown"]) == ["python", "typescript", "cpp", "plain", "plain"]


def test_text_predicate(spark):
    rows = spark.createDataFrame([(0, b"ok"), (1, b"a\x00"), (2, b"x" * 8192 + b"\x00"), (3, b"x" * 8191 + b"\x00"), (4, b"\xff\xfe"), (5, b"")], "i int, c binary")
    assert [r[0] for r in rows.orderBy("i").select(paths.is_text(F.col("c"))).collect()] == [True, False, True, False, False, True]


def test_wrapped_lines(spark):
    wrap = lambda most: lambda c: text.wrapped(c, 6.0, {"i": 0.5, " ": 1.0}, 1.0, most)
    assert values(spark, wrap(3), ["", None, "ab cd ef", "ab cde  f", "toolongaword x", "iiii iiii i", " lead", "a b c d e f g h i j"]) == [
        [], [], ["ab cd", "ef"], ["ab cde", "f"], ["toolongaword", "x"], ["iiii iiii", "i"], ["lead"], ["a b c", "d e f", "g h i"]]
    assert values(spark, wrap(2), ["aaaa bbbb cccc"]) == [["aaaa", "bbbb"]]


def test_one_pattern_serves_columns_and_python(spark):
    given = ["a\n/b.gz", "a/..gz", "a/.gz", "a/b.Gz", "a/b.gzx", "..", "//", "x/out/y", "x/out", "outer/y", "a/b.egg-info/c", "é/ü.PDF", ".catalog/a", "x/.catalog/a"]
    import re

    pattern = re.compile(paths.excluded_path())
    assert values(spark, paths.allowed_path, given) == [pattern.search(p) is None for p in given]
    assert [pattern.search(p) is None for p in given] == [False, True, True, False, True, False, False, False, True, True, False, False, True, False]
