from __future__ import annotations

import hashlib
import math
import random
import re
import time
from unittest import mock

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from ledgerloom.llm import chat, urls

PIECES = ["<s>", "</s>", "[INST]", "[/INST]", "\\", "\\s", "<", "</s", "s>", "[", "x", "é", "\n", "1", "", "😀", "<\\s>"]


def formatted(spark, rows):
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string")
    return chat.format_conversations(frame)


def check(spark, rows):
    """Digests of all conversations against the plain ones."""
    out = formatted(spark, [(*r, "clash") for r in rows]).cache()
    assert all(r["identical"] for r in out.select("identical").collect())
    found = {r["conv_id"]: r for r in chat.digests(out).collect()}
    texts = {r["conv_id"]: r["formatted"] for r in out.select("conv_id", "formatted").collect()}
    groups = {}
    for conv, turn, role, text in rows:
        groups.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    assert set(found) == set(groups)
    for conv, turns in groups.items():
        turns.sort()
        loss = "".join(t[3] for t in turns if t[2] == "assistant")
        row = found[conv]
        assert row["n_turns"] == len(turns) and row["loss_chars"] == len(loss) and row["formatted_chars"] == len(texts[conv])
        assert row["turns_sha256"] == hashlib.sha256("".join(f"{t[2]}\n{t[3]}\n" for t in turns).encode()).hexdigest()
        assert row["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()


@settings(max_examples=6, deadline=None)
@given(st.lists(st.lists(st.tuples(st.sampled_from(["user", "assistant", "[/INST]", "a</s>b", ""]), st.lists(st.sampled_from(PIECES), max_size=8).map("".join)), min_size=1, max_size=4), min_size=20, max_size=30))
def test_round_trip_of_conflicting_texts(spark, conversations):
    check(spark, [(c, t, role, text) for c, turns in enumerate(conversations) for t, (role, text) in enumerate(turns)])


def test_nulls_ties_repeats_and_length(spark):
    check(spark, [(1, 0, None, None), (1, 1, "assistant", "a"), (1, 1, "assistant", "a"), (1, 1, "assistant", "A"), (1, None, "user", "first"), (None, 0, "user", "no id"),
                  (2, 0, "user", "</s>[INST] ok [/INST]"), (2, 1, "assistant", "</s>[INST] ok [/INST]"), (3, 0, "assistant", "long </s> " * 20000), (4, 0, "system", "")])
    assert formatted(spark, []).count() == 0


def test_escapes_only_where_needed(spark):
    rows = {r["conv_id"]: r["formatted"] for r in formatted(spark, [(1, 0, "user", "back\\slash", ""), (2, 0, "user", "<s>\\", "")]).collect()}
    assert rows == {1: "<s>[INST]0user[/INST]back\\slash</s>", 2: "<s>[INST]1user[/INST]<\\s>\\\\</s>"}


def test_hosts_and_paths(spark):
    given_urls = ["HTTP://Ex.ORG/A/b?q#f", "x://h", "nothing", None, "", "a://b://c/d", "https://h?x/y", "https://ÄB.org/ü#z", "://", "s://u:p@h:80/p;x"]
    frame = spark.createDataFrame([(k, u) for k, u in enumerate(given_urls)], "page_id long, url string")
    host, path = urls.host_and_path(F.col("url"))
    assert [tuple(r) for r in frame.orderBy("page_id").select(host, path).collect()] == [
        ("ex.org", "/A/b"), ("h", ""), ("", ""), ("", ""), ("", ""), ("b:", "//c/d"), ("h", ""), ("Äb.org", "/ü"), ("", ""), ("u:p@h:80", "/p;x")]


def test_longest_rule_wins_and_templates_judge_the_rest(spark):
    rows = [(0, "http://a.example.org/es/1"), (1, "http://example.org/en/12"), (2, "http://xexample.org/es/1"), (3, "http://org"), (4, "http://m.com/de/1"), (5, "http://m.com/fr/1"), (6, None), (6, None)]
    rows += [(100 + k, f"http://bad.com/de/{k}") for k in range(30)] + [(200 + k, f"http://bad.com/xx/{k}") for k in range(30)]
    rows += [(300 + k, f"http://good.com/fr/{k}") for k in range(30)] + [(400, "http://good.com/zz/9"), (None, "http://good.com/a/b/c/d/e")]
    frame = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, verdict string")
    found = {}
    for r in urls.judge(frame).collect():
        found[r["page_id"]] = r
    assert urls.judge(frame).count() == len(rows)
    assert [found[k]["rule"] for k in range(7)] == ["example.org/es/", "example.org/en/1", "org/", None, "com/de/", "com/fr/", None]
    assert [found[k]["verdict"] for k in (0, 1, 2, 4, 5)] == ["block", "block", "allow", "block", "allow"]
    assert {found[200 + k]["verdict"] for k in range(30)} == {"block"} and found[400]["verdict"] == "allow"
    assert found[None]["template"].endswith("/**") or found[None]["template"].endswith("*")
    assert urls.judge(frame.limit(0)).count() == 0


def test_loss_spans_point_at_the_texts(spark):
    rows = [(1, 0, "user", "é </s> x", ""), (1, 1, "assistant", "😀 plain", ""), (1, 2, "assistant", "[INST] \\ </s>", ""), (1, 2, "assistant", "[INST] \\ </s>", ""), (1, 3, "assistant", "", ""), (2, 0, "user", "only", "")]
    out = {r["conv_id"]: r for r in formatted(spark, rows).collect()}
    texts = []
    for span in out[1]["loss_spans"]:
        text = out[1]["formatted"][span["start"] : span["start"] + span["length"]]
        texts.append(re.sub(r"(?s)\\(.)", r"\1", text) if span["escaped"] else text)
    assert texts == [r[3] for r in rows if r[0] == 1 and r[2] == "assistant"] and out[2]["loss_spans"] == []


def test_a_long_conversation_costs_its_length(spark):
    def seconds(turns):
        rows = spark.range(turns).selectExpr("1L as conv_id", "id as turn", "if(id % 2 = 0, 'user', 'assistant') as role", "concat(repeat('words and ', 10), id) as text")
        best = []
        for _ in range(3):
            began = time.perf_counter()
            found = chat.digests(chat.format_conversations(rows)).collect()
            best.append(time.perf_counter() - began)
            assert found[0]["n_turns"] == turns
        return min(best)

    seconds(2_000)
    assert seconds(64_000) < 4 * seconds(16_000) + 1


def plain_templates(pages):
    """Verdict and template of each url by the module's description, segment by segment, without shortcuts."""
    fits = lambda host, path, rule: (host == rule.split("/")[0] or host.endswith("." + rule.split("/")[0])) and path.startswith("/" + rule.split("/", 1)[1])
    said, rows = {}, []
    for page, url in pages:
        rest = url.split("://", 1)[1] if "://" in url else ""
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        rules = [r for r in urls.RULES if fits(host, path, r[1])]
        said[page] = max(rules, key=lambda r: len(r[1]))[0] if rules else None
        rows.append((page, host, [re.sub("[0-9]+", "#", s) for s in path.split("/") if s]))
    named = {page: () for page, *_ in rows}
    bad, labelled = (lambda group: sum(said[p] == "block" for p in group)), (lambda group: sum(said[p] is not None for p in group))
    for depth in range(max(len(s) for *_, s in rows) + 1):
        nodes = {}
        for page, host, parts in rows:
            if len(named[page]) == depth:  # has read all its segments so far
                nodes.setdefault((host, named[page]), {}).setdefault(parts[depth] if depth < len(parts) else None, []).append(page)
        for children in nodes.values():
            everyone = [p for group in children.values() for p in group]
            rate = (bad(everyone) + 1) / (labelled(everyone) + 2)
            for part, group in children.items():
                if part is None:
                    continue
                variable = len(children) > 8 and len(group) * 8 < len(everyone)
                alike = abs(bad(group) - labelled(group) * rate) <= 2 * math.sqrt(labelled(group) * rate * (1 - rate))
                for page in group:
                    named[page] += ("*" if variable or alike else part,)
    groups, hosts = {}, {}
    for page, host, _ in rows:
        groups.setdefault((host, named[page]), []).append(page)
        hosts.setdefault(host, []).append(page)
    good = lambda group: labelled(group) - bad(group)
    everyone = [p for p, *_ in rows]
    base = (good(everyone) + 1) / (labelled(everyone) + 2)
    out = {}
    for (host, name), group in groups.items():
        prior = (good(hosts[host]) + 2 * base) / (labelled(hosts[host]) + 2)
        purity = (good(group) + 2 * prior) / (labelled(group) + 2)
        for page in group:
            out[page] = (said[page] or ("allow" if purity >= 0.5 else "block"), "/".join([host, *name]))
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_templates_equal_brute_force_at_any_depth(spark, seed):
    rng = random.Random(seed)
    rows = []
    rules = (("allow", "com/fr/"), ("block", "com/de/"), ("block", "com/x/y/z/w/"), ("allow", "com/x/y/z/v/"), ("block", "com/s/t/u/"))
    for page in range(900):
        host = rng.choice(["a.com", "b.com", "b.com", "c.net", "hot.com", "hot.com", "hot.com"])
        start = rng.choice(["fr", "de", "x/y/z/w", "x/y/z/v", "x/y/z/w", "x/y/q", "s/t/u/1", "s/t", ""])
        tail = [rng.choice(["w", "v", f"p{rng.randrange(30)}", "k", str(rng.randrange(99)), "same/same/same"]) for _ in range(rng.randrange(0, 4))]
        rows.append((page, f"http://{host}/" + "/".join([start, *tail])))
    rows += [(2000, "http://deep.com/fr/" + "/".join(["d"] * 300)), (2001, "http://deep.com/fr/" + "/".join(["d"] * 299) + "/e"), (2002, "none"), (2003, "http://long.com/" + "l" * 5000)]
    with mock.patch.object(urls, "RULES", rules):
        want = plain_templates(rows)
    found = urls.judge(spark.createDataFrame(rows, "page_id long, url string"), rules)
    assert {r["page_id"]: (r["verdict"], r["template"]) for r in found.collect()} == want


def test_a_wrong_mask_shows_in_the_digests(spark):
    rows = [(k % 5, k, ("user", "assistant")[k % 2], f"text {k} é\\ {'</s>' if k % 3 == 0 else ''} end") for k in range(60)] + [(None, 1, "assistant", "null id"), (9, 0, "user", "no loss")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = chat.format_conversations(frame).cache()
    fine = {r["conv_id"]: (r["loss_chars"], r["loss_sha256"]) for r in chat.digests(out).collect()}
    for conv in (0, 1, 2, 3, 4, None, 9):
        text = "".join(r[3] for r in sorted((r for r in rows if r[0] == conv), key=lambda r: r[1]) if r[2] == "assistant")
        assert fine[conv] == (len(text), hashlib.sha256(text.encode()).hexdigest())
    moved = out.withColumn("mask", F.transform("mask", lambda m: F.when(m.isNotNull(), F.struct((m["start"] + 1).alias("start"), m["length"].alias("length"), m["escaped"].alias("escaped")))))
    wrong = {r["conv_id"]: (r["loss_chars"], r["loss_sha256"]) for r in chat.digests(moved).collect()}
    assert all(wrong[c] != fine[c] for c in fine if c != 9)
