from __future__ import annotations

import os
import random
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from ledgerloom.llm import mixing, packing, toxicity
from tests.llm.test_lines import plain as plain_lines
from tests.llm.test_mixing_packing import plain_targets
from tests.llm.test_simhash import plain_fingerprint, plain_groups
from tests.test_queries import SF, TABLES, plain

public_tokenizers = pytest.importorskip("public_tokenizers")


def documents():
    rng = random.Random(6)
    words = [f"{a}{b}" for a in ("ra", "te", "mo", "si", "lu") for b in ("n", "st", "l", "rk", "ve", "d")]
    passage = " ".join(rng.choice(words) for _ in range(60))
    rows = []
    for k in range(300):
        text = [" ".join(rng.choice(words) for _ in range(rng.randrange(3, 40))) for _ in range(rng.randrange(1, 5))]
        if k % 9 == 0:
            text.append(passage)
        if k % 10 == 3:
            text = [" ".join(x + " numbskull" if n % 4 == 0 else x for n, x in enumerate(line.split())) for line in text]
        rows.append([k, "\n".join(text), "en", f"src{k % 4 if k % 3 else 0}", 0])
    rows[50][1] = rows[20][1]  # an exact copy
    rows[60][1] = rows[21][1].replace("\n", " \n", 1)  # a copy but for white space
    rows += [[300, "", "en", "src0", 0], [301, None, "en", None, None], [302, "w " * 9000, "en", "src1", 0]]
    return [(*r[:4], None if r[1] is None else len(r[1])) for r in rows]


def test_each_stage_against_brute_force(spark, tmp_path):
    rows = documents()
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    frame.write.parquet(str(tmp_path / "documents.parquet"))
    labels = spark.createDataFrame([(k, int(k % 10 == 3)) for k in range(300)], "doc_id long, toxic int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "line dedup", "simhash near-dedup", "mixing", "packing"]

    given, results = frame, {}
    for name, stage in corpus_pipeline.STAGES:
        results[name] = given = stage(spark, given, str(tmp_path)).cache()
        if name != "packing":
            assert given.columns == frame.columns
    texts = lambda name: {r["doc_id"]: r["text"] for r in results[name].collect()}

    model = toxicity.fit(frame, labels, train=F.crc32(F.col("_id").cast("string")) % 5 != 0)
    scores = toxicity.score_texts(model, [r[1] for r in rows])
    clean = {r[0]: r[1] for r, s in zip(rows, scores, strict=True) if s < 0.5}
    assert texts("toxicity") == clean
    assert not {k for k in range(300) if k % 10 == 3} & set(clean) and len(clean) == 273

    deleted = plain_lines({k: t for k, t in clean.items() if t is not None}, 1)
    kept = {}
    for k, text in clean.items():
        lines = (text or "").split("\n")
        left = [x for n, x in enumerate(lines) if text is None or n not in deleted[k][0]]
        if text is None or len(left) == len(lines) or any(x.strip() for x in left):
            kept[k] = None if text is None else "\n".join(left)
    assert texts("line dedup") == kept
    assert 50 not in kept and sum("numbskull" in (t or "") for t in kept.values()) == 0

    ids = sorted(kept)
    label = plain_groups([plain_fingerprint(kept[k]) for k in ids])
    assert texts("simhash near-dedup") == {ids[x]: kept[ids[x]] for x in set(label)}

    sizes, taken, times = Counter(), Counter(), Counter(r["doc_id"] for r in results["mixing"].collect())
    for r in results["simhash near-dedup"].collect():
        size = len((r["text"] or "").split())
        sizes[r["source"]] += size
        taken[r["source"]] += size * times[r["doc_id"]]
        assert times[r["doc_id"]] <= 2
    for source, target in plain_targets(sizes).items():
        assert abs(taken[source] - target) <= 0.5 or sizes[source] > 9000

    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(str(public_tokenizers.path("word_bpe_49k.json")))
    want = Counter()
    for r in results["mixing"].collect():
        ids = [*tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, 1]
        for piece, start in enumerate(range(0, len(ids), 4096)):
            part = np.array(ids[start : start + 4096], "<u4")
            want[(r["doc_id"], piece, start, len(part), zlib.crc32(part.tobytes()))] += 1
    found, bins = Counter(), defaultdict(list)
    for r in results["packing"].collect():
        found[tuple(r)[:5]] += 1
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    assert found == want
    for parts in bins.values():
        ends = [o + n for o, n in sorted(parts)]
        assert [o for o, _ in sorted(parts)] == [0, *ends[:-1]] and ends[-1] <= 4096
    assert len(bins) == -(-sum(n for *_, n, _ in want.elements()) // 4096)
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == sum(found.values())


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
@pytest.mark.parametrize("name", ["op3_chat_formatting", "op4_url_filters", "op5_line_dedup", "op5_line_dedup_whole", "op6_exact_top_k", "op11_jaccard_join", "op12_filter_audit", "op13_merkle_manifest"])
def test_operator_queries_equal_their_sql(spark, name):
    duck = duckdb.connect()
    for table in TABLES:
        duck.execute(f"create view {table} as select * from '{SF}/{table}.parquet'")
    found = __spark_entry__.queries()[name](spark, SF)
    wanted = duck.execute(__spark_entry__.oracle_sql()[name])
    columns = [d[0] for d in wanted.description]
    order = sorted(columns)
    assert order == sorted(found.columns)
    rows = sorted(repr([plain(r[c]) for c in order]) for r in found.collect())
    assert rows == sorted(repr([plain(dict(zip(columns, r))[c]) for c in order]) for r in wanted.fetchall())


def test_all_operators_are_registered():
    names = set(__spark_entry__.queries())
    assert {n.split("_")[0] for n in names if n.startswith("op")} == {f"op{k}" for k in range(1, 14)} and "pipeline" in names


def odd(frame):
    """Columns of every kind, some named like what the stages use, some with characters that names seldom have."""
    more = {"a.b": F.lit("x"), "m`n": F.col("doc_id"), "tags": F.create_map(F.lit("k"), F.col("doc_id")), "list": F.array(F.col("source")), "record": F.struct(F.col("lang").alias("in.ner"), F.create_map(F.lit(1), F.lit("v")).alias("map")),
            "_score": F.lit(1), "_doc": F.lit(2), "_fp": F.lit(3), "_words": F.lit(4), "_group": F.lit(5), "score": F.lit(6), "n_lines": F.lit(7), "size": F.lit(8), "_texthash": F.lit(9)}
    return frame.select("*", *[c.alias(name) for name, c in more.items()])


def test_stages_keep_columns_of_any_name_and_kind(spark, tmp_path):
    rows = [r for r in documents() if r[0] < 120] + [(None, "null id one two three four five", "en", "src1", 5), (None, None, None, None, None), (7, "another text of the same id here", "en", "src1", 3)]
    frame = odd(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"))
    frame.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(k, int(k % 10 == 3)) for k in range(120)], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    given = frame
    for name, stage in corpus_pipeline.STAGES[:-1]:
        path = str(tmp_path / name)
        stage(spark, given, str(tmp_path)).write.parquet(path)
        given = spark.read.parquet(path)
        assert given.columns == frame.columns and 0 < given.count(), name
    last = given.where("doc_id is not null").select("doc_id", "`a.b`", "`m``n`", "tags", "list", "record", "_score").collect()
    assert all(r["a.b"] == "x" and r["m`n"] == r["doc_id"] and r["tags"] == {"k": r["doc_id"]} and r["record"]["map"] == {1: "v"} and r["_score"] == 1 for r in last)
    assert corpus_pipeline.STAGES[-1][1](spark, given, str(tmp_path)).count() >= given.count()


def test_packing_keeps_columns_of_any_name(spark):
    pieces = spark.createDataFrame([(k, 0, 1000 + k, {"a": k}) for k in range(10)], "doc_id long, piece int, length long, `x.y` map<string,long>")
    packed = packing.pack(pieces, 4096).collect()
    assert sorted(r["x.y"]["a"] for r in packed) == list(range(10))


def test_stages_on_an_empty_table(spark, tmp_path):
    frame = odd(spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long"))
    spark.createDataFrame(documents()[:100], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(k, int(k % 10 == 3)) for k in range(100)], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for name, stage in corpus_pipeline.STAGES:
        found = stage(spark, frame, str(tmp_path))
        assert found.count() == 0, name


def test_the_mix_takes_the_same_texts_of_an_id_again(spark):
    rows = [(7, f"text number {k} has words", "s") for k in range(40)] + [(8, "one more source with some words " * 9, "t")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
    kept = [Counter(r["text"] for r in mixing.mixed(given).collect()) for given in (frame, frame.orderBy("text").repartition(3), frame.orderBy(F.desc("text")).coalesce(1))]
    assert kept[0] == kept[1] == kept[2] and len(set(kept[0].values())) > 1
