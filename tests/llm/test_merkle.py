from __future__ import annotations

import zlib
from hashlib import sha256

import duckdb
import pytest

from ledgerloom.llm import merkle, sql


def plain_hash(text):
    return sha256(text.encode()).hexdigest()


def plain_leaf(row):
    return plain_hash("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def plain_tree(nodes):
    """The levels of a tree, leaves first."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([plain_hash("".join(last[k : k + 8])) for k in range(0, len(last), 8)])
    return levels


def plain_climb(levels, at, leaf):
    """The siblings of a leaf, in order, and the root that a leaf in its place leads to."""
    siblings = []
    for level in levels[:-1]:
        first = at // 8 * 8
        run = level[first : first + 8]
        before, after = run[: at - first], run[at - first + 1 :]
        siblings += before + after
        leaf, at = plain_hash("".join([*before, leaf, *after])), at // 8
    return siblings, leaf


def plain_manifest(rows):
    """``rows``: (doc_id, source, lang, n_chars, text)."""
    def lower(text):
        return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)

    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    trees, own = [], []
    for lang in langs:
        mine = sorted((r for r in rows if r[2] == lang), key=lambda r: (r[0] is not None, r[0] or 0, plain_leaf(r)))
        trees.append(plain_tree([plain_leaf(r) for r in mine]))
        own.append(mine)
    outer = plain_tree([t[-1][0] for t in trees])
    out = []
    for number, (tree, mine) in enumerate(zip(trees, own, strict=True)):
        for at, row in enumerate(mine):
            changed = row
            if row[0] is not None and row[4] is not None and zlib.crc32(str(row[0]).encode()) % 3 == 0:
                changed = (*row[:4], lower(row[4]))
            inner, folded = plain_climb(tree, at, plain_leaf(changed))
            more, folded = plain_climb(outer, number, folded)
            root = outer[-1][0]
            out.append((row[0], plain_leaf(row), tree[-1][0], root, plain_hash("".join(inner + more)), folded, folded == root))
    return out


def rows_of(counts):
    rows = []
    for lang, n in counts.items():
        for k in range(n):
            text = [f"Text {k} of {lang}", None, "", "ÄÖ lower only", f"É BIG {k}"][k % 5]
            rows.append((len(rows) * 7 % 1000 + len(rows), None if k % 4 == 3 else f"src{k % 3}", lang, None if k % 6 == 5 else k, text))
    return rows


COLUMNS = "doc_id long, source string, lang string, n_chars long, text string"
NAMES = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def found(spark, rows, depth):
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], COLUMNS + ", block int, `a.place` string")
    return sorted(map(tuple, merkle.manifest(docs, depth).select(*NAMES).collect()), key=repr)


@pytest.mark.parametrize(("counts", "depth"), [({"en": 1}, 4), ({"en": 8, None: 1}, 1), ({"en": 70, "de": 9, "": 1, None: 2, "é": 65}, 1), ({f"l{k}": 1 + k % 3 for k in range(10)}, 2),
                                               ({"en": 530, "fr": 64}, 2), ({"en": 513}, 4)])
def test_equals_a_plain_tree(spark, counts, depth):
    rows = rows_of(counts)
    assert found(spark, rows, depth) == sorted(plain_manifest(rows), key=repr)


HARD = [(5, "a", "en", 3, "Same"), (5, "a", "en", 3, "Same"), (5, "b", "en", 3, "Same"), (None, None, None, None, None), (None, "a", "en", 1, "No Id"), (-7, "a", "en", 1, "Below"),
        (9, "a", "en", 10**6, "Long " * 200_000), (12, "a", "EN", 1, "Upper"), *[(77, "hot", "en", 1, "Copy")] * 30]


def test_hard_rows(spark):
    assert found(spark, HARD, 1) == sorted(plain_manifest(HARD), key=repr)


def test_sql_on_hard_rows():
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, source varchar, lang varchar, n_chars bigint, text varchar)")
    con.executemany("insert into documents values (?, ?, ?, ?, ?)", HARD)
    assert sorted(con.execute(f"select {', '.join(NAMES)} from ({sql.OP13})").fetchall(), key=repr) == sorted(plain_manifest(HARD), key=repr)


def test_empty_table(spark):
    assert merkle.manifest(spark.createDataFrame([], COLUMNS)).select(*NAMES).collect() == []
