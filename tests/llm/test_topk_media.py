from __future__ import annotations

import hashlib
import html as html_module
import math
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import media, queries, topk


def plain_top(rows, every, k):
    fine = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = set()
    for q, a in {i: v for i, v in fine if i % every == 0}.items():
        scored = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in fine if i != q)
        out |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(scored[:k])}
    return out


def test_equals_brute_force(spark):
    rng = random.Random(5)
    rows = [(k, [rng.gauss(0, 0.2) for _ in range(8)]) for k in range(400)]
    rows += [(k, [0.25] * 8) for k in range(400, 700)]  # a very common vector
    rows += [(k, [0.0] * 8) for k in range(700, 750)]
    rows += [(800, None), (850, [None] * 8), (900, [math.nan] * 8), (950, [math.inf] * 8), (None, [1.0] * 8), (1000, []), (1050, [0.5, -0.5])]
    frame = spark.createDataFrame([(i, v, "clash") for i, v in rows], "vec_id long, embedding array<double>, score string")
    found = topk.self_search(frame).collect()
    assert {tuple(r) for r in found} == plain_top(rows, 50, 5) and len(found) == len(plain_top(rows, 50, 5))


def test_huge_components_and_few_vectors(spark):
    rows = [(0, [1.0e6, -2.0]), (50, [1.0e6, 1.0]), (1, [1.0e3, 5.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = {(r["query_id"], r["rank"], r["vec_id"]) for r in topk.self_search(frame).collect()}
    assert found == {(0, 1, 50), (0, 2, 1), (50, 1, 0), (50, 2, 1)}
    assert {r["score"] for r in topk.self_search(frame).collect()} == {256_000_000**2 - 512 * 256, 256_000_000 * 256_000 - 512 * 1280, 256_000_000 * 256_000 + 256 * 1280}
    saturated = spark.createDataFrame([(0, [3.0e15]), (50, [3.0e15])], "vec_id long, embedding array<double>")
    assert len({r["score"] for r in topk.self_search(saturated).collect()}) == 1
    assert topk.self_search(frame.limit(0)).count() == 0


@pytest.mark.parametrize("payload", [b"\0" * 64, bytes(range(256)), b"a" * 6400])
def test_png_round_trip(payload):
    stored = media.to_png(payload)
    assert media.from_png(stored) == payload
    with pytest.raises(ValueError, match="damaged"):
        media.from_png(stored[:40] + bytes([stored[40] ^ 1]) + stored[41:])


def test_document_media_reads_back_every_text(spark):
    texts = ["", None, "a", "x" * 64, "x" * 65, "é" * 50, "x" * 64, "a\0", "long " * 50_000]
    frame = spark.createDataFrame([(k, t, "clash") for k, t in enumerate(texts)] + [(None, "a", "n"), (0, "", "again")], "doc_id long, text string, digest string")
    found = media.document_media(frame).collect()
    assert len(found) == len(texts) + 2
    for r in found:
        if r["doc_id"] is None:
            continue
        data = (texts[r["doc_id"]] or "").encode()
        padded = data + b"\0" * (max(1, -(-len(data) // 64)) * 64 - len(data))
        stored = media.to_png(padded)
        assert tuple(r)[1:] == (len(data), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]), len(stored), hashlib.sha256(stored).hexdigest(), media.feature_of(padded))
    assert media.document_media(frame.limit(0)).count() == 0


def test_sequences_keep_order_and_captions(spark):
    html = ('<p>Before &amp; <b>bold</b></p><script>x("<img src=media:no>")</script><figure><img src="media:aa" alt="old"><figcaption>The  caption</figcaption></figure>'
            '<img src="media:bb" alt="alternative"><img src="http://elsewhere"><p>After<img src="media:zz">')
    frame = spark.createDataFrame([(1, html), (2, None), (3, "")], "page_id long, html string")
    parsed = media.sequences(frame, "page_id", "html")
    items = {r["page_id"]: [(i["position"], i["kind"], i["text"] or i["digest"], i["caption"]) for i in r["items"]] for r in parsed.collect()}
    assert items == {1: [(0, "text", "Before & bold", None), (1, "media", "aa", "The caption"), (2, "media", "bb", "alternative"), (3, "text", "After", None), (4, "media", "zz", None)], 2: [], 3: []}
    store = spark.createDataFrame([("aa", 7)], "digest string, payload_bytes long")
    found = {(r["position"], r["payload_bytes"]) for r in media.resolve(media.references(parsed), store).collect()}
    assert found == {(1, 7), (2, None), (4, None)}


def test_an_id_with_several_vectors_is_several_queries(spark):
    rows = [(0, [1.0, 0.0]), (0, [0.0, 1.0]), (0, [0.0, 1.0]), (1, [1.0, 0.0]), (2, [0.0, 2.0])]
    found = topk.self_search(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert sorted(tuple(r) for r in found) == [(0, 1, 1, 65536), (0, 1, 2, 131072), (0, 2, 1, 0), (0, 2, 2, 0)]


def test_a_third_of_the_rows_with_one_id_is_spread(spark):
    rng = random.Random(2)
    rows = [(7, [rng.gauss(0, 1) for _ in range(4)]) for _ in range(300)] + [(k, [rng.gauss(0, 1) for _ in range(4)]) for k in range(100, 700)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)
    assert sorted(tuple(r) for r in topk.self_search(frame).collect()) == sorted(plain_top(rows, 50, 5))


def plain_png(stored):
    """Samples of a grey 8-bit image by the format's own rules."""
    assert stored[:8] == bytes([137, 80, 78, 71, 13, 10, 26, 10])
    at, chunks = 8, []
    while at < len(stored):
        size = int.from_bytes(stored[at : at + 4], "big")
        kind, body = stored[at + 4 : at + 8], stored[at + 8 : at + 8 + size]
        assert zlib.crc32(kind + body) == int.from_bytes(stored[at + 8 + size : at + 12 + size], "big")
        chunks.append((kind, body))
        at += 12 + size
    assert [k for k, _ in chunks] == [b"IHDR", b"IDAT", b"IEND"]
    width, height = int.from_bytes(chunks[0][1][:4], "big"), int.from_bytes(chunks[0][1][4:8], "big")
    assert chunks[0][1][8:] == bytes([8, 0, 0, 0, 0])
    raw = zlib.decompress(chunks[1][1])
    assert len(raw) == height * (width + 1) and not any(raw[:: width + 1])
    return b"".join(raw[k + 1 : k + 1 + width] for k in range(0, len(raw), width + 1))


def plain_feature(payload):
    columns = [sum(payload[k::64]) for k in range(64)]
    bits = "".join("1" if c * 64 > sum(payload) else "0" for c in columns)
    return f"{int(bits, 2):016x}-{sum(payload) * 1000 // len(payload)}"


def test_media_against_the_format_itself(spark):
    texts = {k: t for k, t in enumerate(["", None, "a", "x" * 64, "x" * 65, "\u20ac\u00e9 <b>&amp;</b>\nsecond line\n\n third", "x" * 64, "many\nlines\n" * 500])}
    payloads = {}
    for k, t in texts.items():
        data = (t or "").encode()
        payloads[k] = data + bytes(max(1, -(-len(data) // 64)) * 64 - len(data))
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    store = media.encode_media(frame.select(media.payload_of(F.col("text")).alias("payload"))).collect()
    held = {r["digest"]: bytes(r["media"]) for r in store}
    assert len(store) == len(set(payloads.values())) and all(hashlib.sha256(plain_png(m)).hexdigest() == d for d, m in held.items())
    for r in media.placed_media(frame).collect():
        payload, text = payloads[r["doc_id"]], texts[r["doc_id"]] or ""
        stored = held[hashlib.sha256(payload).hexdigest()]
        assert (r["media_bytes"], r["media_sha256"], r["feature"]) == (len(stored), hashlib.sha256(stored).hexdigest(), plain_feature(payload))
        lines = [bool(x.split()) for x in text.split("\n")]
        assert (r["position"], r["caption"]) == (int(lines[0]), f"Text of {len(text.encode())} bytes")
        assert (r["n_items"], r["last_position"]) == (sum(lines) + 4, sum(lines) + 3)


@pytest.mark.parametrize(("html", "items", "outside"), [
    ('<img src="media:a" alt=A><p>x</p><figcaption>stray</figcaption>', [("a", "A"), "x", "stray"], []),
    ('<figure><img src="media:o"><figure><img src="media:i" alt=I><figcaption>inner</figcaption></figure><figcaption>outer</figcaption></figure>', [("o", "outer"), ("i", "inner")], []),
    ('<figure><figure><img src="media:i" alt=I></figure><figcaption>outer <b>one</b></figcaption></figure><img src="media:z">', [("i", "outer one"), ("z", None)], []),
    ('<figure><img src="media:a"><figcaption>cap<p>first</p></figure><p>rest</p>', [("a", "cap first"), "rest"], []),
    ('<figure><img src="media:a"><figcaption>cap<p>rest</p><p>more</p>', [("a", "cap"), "rest", "more"], []),
    ('<article><figure><img src="media:a"><figcaption>cap</article><p>rest', [("a", "cap"), "rest"], []),
    ('<figure><figcaption>before</figcaption><p>in</p><img src="media:a"><img src="media:b" alt=B></figure>', ["in", ("a", "before"), ("b", "before")], []),
    ('<p>t<figure><figcaption>no media</figcaption></figure></p>u', ["t", "no media", "u"], []),
    ('<p>t</p><figure><img src="https://x/y.png" alt=Y><figcaption>far</figcaption></figure><video src=v.mp4></video><p>u<img src="media:a">', ["t", "u", ("a", None)], [(1, "https://x/y.png", "far"), (1, "v.mp4", None)]),
    ("</figure></figcaption></p><figcaption>", [], []),
])
def test_positions_and_captions_of_any_page(html, items, outside):
    found, far = media.parse_page(html)
    assert [(i["digest"], i["caption"]) if i["kind"] == "media" else i["text"] for i in found] == items
    assert [i["position"] for i in found] == list(range(len(items)))
    assert [(o["position"], o["src"], o["caption"]) for o in far] == outside


def test_references_of_all_media_elements():
    html = """<title>T</title><template>a</template><noscript>b</noscript><textarea>c</textarea>x<hr>y
    <img src="MEDIA:one" srcset="two.png 1x, media:three 2x , two.png" data-src=" four ">
    <video poster="p.png" src="v.mp4"><source src="s.webm"><track src="t.vtt"></video><object data="o.pdf"></object><iframe src="f.html"></iframe><embed src="e.swf"><audio data-src="a.mp3"></audio>"""
    items, outside = media.parse_page(html)
    assert [i["text"] for i in items if i["kind"] == "text"] == ["T", "a", "b", "c", "x", "y"]
    assert [i["digest"] for i in items if i["kind"] == "media"] == ["one", "three"]
    assert [o["src"] for o in outside] == ["four", "two.png", "v.mp4", "p.png", "s.webm", "t.vtt", "o.pdf", "f.html", "e.swf", "a.mp3"]
    assert media.sources_of("img", {"srcset": "a.png, b.png 2x,c.png 300w"}) == ["a.png", "b.png", "c.png"] and media.sources_of("p", {"src": "x"}) == []


def test_pages_lose_no_word_and_no_reference(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    found = {r["page_id"]: r for r in queries.QUERIES["media_sequences"](spark, "/root/testdata/sf0.01").collect()}
    rows = pages.collect()
    assert len(found) == len(rows)
    for row in rows:
        silent = re.sub(r"(?is)<!--.*?-->|<(script|style)\b.*?</\1\s*>", " ", row["html"] or "")
        plain = html_module.unescape(re.sub(r"(?s)<[^>]*>", "", re.sub(r"(?i)<(/?(?:p|div|h[1-6]|li|ul|ol|td|th|tr|table|title|br|hr|nav|header|footer|main|section|article|aside|body|html|head|form|button|figure|figcaption|blockquote|option|select|label|pre)\b)", r" <\1", silent)))
        assert found[row["page_id"]]["words"] == len(plain.split()), row["page_id"]
        assert found[row["page_id"]]["n_media"] + found[row["page_id"]]["n_outside"] == len(re.findall(r"(?i)<(?:img|audio|video|source|iframe|embed|track)\b[^>]*\bsrc\s*=\s*[\"']?[^\"'\s>]", silent))
