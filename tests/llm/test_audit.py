from __future__ import annotations

import re
from collections import Counter
from itertools import permutations

import duckdb
import pytest

from ledgerloom.llm import audit, queries, sql


def plain_flags(text, late):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    found = "A" if len(words) < 200 else ""
    found += "B" if 100 * len(set(words)) < 50 * len(words) else ""
    found += "C" if 100 * sum("A" <= c <= "Z" for c in text) > 2 * len(text) else ""
    found += "D" if re.search("[#$%&*|]", text) else ""
    return found + ("E" if late else "")


def plain_audit(docs, labels):
    texts = [(k, s or "", t or "") for k, t, s in docs]
    late = [k is not None and any(o is not None and o < k and u == t for o, _, u in texts) for k, _, t in texts]
    good, toxic = ({k for k, *said in labels if k is not None and said[at] == 1} for at in (0, 1))
    out = {}
    for part in {s for _, s, _ in texts}:
        rows = [(k, plain_flags(t, x)) for (k, s, t), x in zip(texts, late, strict=True) if s == part]
        shapley = Counter()
        for order in permutations("ABCDE"):
            left = rows
            for step, letter in enumerate(order, 1):
                here = [r for r in left if letter in r[1]]
                left = [r for r in left if letter not in r[1]]
                shapley[letter] += len(here)
                out[part, "".join(order), step] = [len(left), len(here), sum(letter in f for _, f in rows) - len(here), sum(f == letter for _, f in rows),
                                                   sum(k in good for k, _ in here), sum(k in toxic for k, _ in here)]
        for (p, order, step), counts in out.items():
            if p == part:
                counts.append(shapley[order[step - 1]])
    return out


LONG = " ".join(f"w{k}" for k in range(260))
DULL = "again and " * 150
DOCS = [(1, LONG, "a"), (2, LONG, "a"), (3, LONG + " # ", "b"), (4, DULL, None), (5, DULL, ""), (6, None, "a"), (7, "", "b"), (8, "LOUD words", "b"), (8, "LOUD words", "b"),
        (9, "LOUD words", "b"), (None, LONG, "a"), (None, "x", "c"), (10, "É" * 60 + "AB", "c"), (11, "É" * 98 + "AB", "c"), (12, "É" * 99 + "A\x0b " + LONG, "c"),
        (13, "one | two", "c"), (14, " \t\r\n\x0c ", "c"), (15, "word " * 100_000, "a"), (0, "word " * 100_000, "b"), (16, LONG.upper(), "a")]
LABELS = [(1, 1, 0), (2, 1, 0), (3, 0, 1), (4, None, 1), (4, 1, None), (8, 1, 1), (9, 0, 0), (15, 1, 0), (15, 2, 2), (99, 1, 1), (None, 1, 1)]


def frames(spark):
    docs = spark.createDataFrame([(k, t, s, 7, 1) for k, t, s in DOCS], "doc_id long, text string, source string, part int, `a.mask` int")
    return docs, spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")


def test_equals_a_plain_replay(spark):
    found = {(r["part"], r["filter_order"], r["step"]): [r[c] for c in (*audit._COUNTS, "shapley")] for r in audit.audit(*frames(spark)).collect()}
    assert found == plain_audit(DOCS, LABELS)


def test_equals_its_sql_on_hard_rows(spark):
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar, source varchar)")
    con.executemany("insert into documents values (?, ?, ?)", DOCS)
    con.execute("create table labels (doc_id bigint, quality int, toxic int)")
    con.executemany("insert into labels values (?, ?, ?)", LABELS)
    wanted = con.execute(sql.OP12)
    names = [d[0] for d in wanted.description]
    found = audit.audit(*frames(spark)).select(*names).collect()
    assert sorted(map(tuple, found)) == sorted(wanted.fetchall())


def test_shares_add_up(spark):
    rows = audit.audit(*frames(spark)).collect()
    for part in {r["part"] for r in rows}:
        own = [r for r in rows if r["part"] == part]
        dropped = {r["filter_order"]: sum(x["removed"] for x in own if x["filter_order"] == r["filter_order"]) for r in own}
        shares = {r["filter_order"][r["step"] - 1]: r["shapley"] for r in own}
        assert len(set(dropped.values())) == 1 and sum(shares.values()) == 120 * dropped["ABCDE"]


def test_empty_tables(spark):
    docs, labels = frames(spark)
    assert audit.audit(docs.limit(0), labels).count() == 0
    assert {r["good_lost"] + r["toxic_lost"] for r in audit.audit(docs, labels.limit(0)).collect()} == {0}


@pytest.mark.parametrize("sf", ["sf0.001"])
def test_query_has_all_rows(spark, sf):
    found = queries.QUERIES["op12_filter_audit"](spark, f"/root/testdata/{sf}")
    docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet")
    assert found.count() == 600 * docs.select("source").distinct().count()
