"""Operators on pages and vectors against brute force, with the same edges."""

import base64
import hashlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from salesloom.llm import ann_forest, html_text, url_filter, warc
from salesloom.llm.queries import URL_RULES

URLS = [
    "http://www.Example.COM/en/1", "https://sub.www.example.com/en/x?y#z", "http://example.com/en/", "http://example.com/en",
    "http://badexample.com/en/1", "ftp://a.net/es/1", "x://net/fr/", "http://com", "http://com/", "no scheme", "", None,
    "http://" + "a." * 3000 + "com/" + "p/" * 3000, "http://host.net:80/es/", "a://b://c.com/en/", "http:///path", "http://x.com?q=/en/",
]


def _judge(url):
    rest = (url or "").split("://", 1)[1] if "://" in (url or "") else ""
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:]
    path = path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]
    best = (0, None, "allow")
    for verdict, h, p in URL_RULES:
        if (host == h or host.endswith("." + h)) and path.startswith(p) and len(h + p) > best[0]:
            best = (len(h + p), h + p, verdict)
    return host, path, best[1], best[2]


def test_urls(spark):
    rows = [(n if n != 3 else None, u) for n, u in enumerate(URLS)] + [(0, URLS[0])]
    pages = spark.createDataFrame(rows, "page_id long, url string").withColumns({c: F.lit(1) for c in ("host", "rule", "row", "digest")})
    rules = url_filter.rules_frame(spark, URL_RULES)
    got = Counter(map(tuple, url_filter.judge(pages, rules).collect()))
    assert got == Counter((i, *_judge(u)) for i, u in rows)
    assert url_filter.judge(pages.limit(0), rules).count() == 0
    assert url_filter.judge(pages, rules.limit(0)).where("verdict <> 'allow' OR rule IS NOT NULL").count() == 0


def test_rule_precedence(spark):
    rules = [("allow", "a.com", "/x"), ("block", "a.com", "/x"), ("block", "b.a.com", "/"), ("allow", "com", "/abcdef/gh"), (None, "a.com", "/"), ("block", "", "/")]
    pages = spark.createDataFrame([(1, "h://a.com/xyz"), (2, "h://b.a.com/xyz"), (3, "h://a.com/abcdef/ghi")], "page_id long, url string")
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in url_filter.judge(pages, url_filter.rules_frame(spark, rules)).collect()}
    assert got == {1: ("a.com/x", "block"), 2: ("b.a.com/", "block"), 3: ("com/abcdef/gh", "allow")}


@pytest.mark.parametrize(
    "html, text",
    [
        (None, ""),
        ("", ""),
        ("<p>one<p>two", "one\n\ntwo"),
        ("a <b> b</b>c<br>d", "a bc\nd"),
        ("<ul><li>x<li>y<ol start=3><li>q<li>r</ol><li>z</ul>", "- x\n- y\n  3. q\n  4. r\n- z"),
        ("<table><tr><th>Name<th>Qty<tr><td>apple<td>3<tr><td>fig<td>12</table>", "Name   Qty\napple  3\nfig    12"),
        ("<table><tr><td colspan=2>a long head<tr><td>x<td>y</table>", "a long head\nx  y"),
        ("x<script>a<b</script>y<style>p{}</style><!-- c > -->z<template>t</template>", "xyz"),
        ("<div hidden>n</div><div style='display: NONE'>n</div><p style=\"color:red\">v", "v"),
        ("<pre>  a\n   b</pre>c", "  a\n   b\n\nc"),
        ("1 &lt; 2 &amp;&amp; 3 < 4 &copy;", "1 < 2 && 3 < 4 ©"),
        ("<title>t</title>a</div></p>b", "a\n\nb"),
        ("<a href='x>y'>l</a> <q", "l"),
        ("<div>" * 3000 + "deep", "deep"),
        ("<dl><dt>T<dd>D</dl>", "T\n  D"),
    ],
)
def test_visible_text(html, text):
    assert html_text.visible_text(html) == text


def test_pages_are_extracted_row_by_row(spark):
    rows = [(1, "<p>a"), (1, "<p>a"), (None, None), (2, "<li>" + "w " * 50_000)]
    pages = spark.createDataFrame(rows, "page_id long, html string").withColumn("text", F.lit("clash"))
    got = Counter(map(tuple, html_text.extract(pages).collect()))
    assert got == Counter((i, html_text.visible_text(h)) for i, h in rows)
    assert html_text.extract(pages.limit(0)).count() == 0


MAGIC = "WARC/1.0\r\n"
INNER = MAGIC + "WARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
PAYLOADS = [
    "<p>one", "<p>two", "<p>one", None, "", "x" * 300_000, "é漢\r\n\r\nWARC", INNER, "a" + MAGIC + "b" + MAGIC, MAGIC, INNER + INNER + "tail", "<p>one",
    *(f"{MAGIC}Content-Length: {n}\r\n\r\nrest" for n in ("abc", "9223372036854775807", "99999999999999999999", "999999999999999999", "-5", "", " 7")),
]


def test_archives_come_back_whole(spark, tmp_path):
    rows = [(n, f"http://x/{n}\r\nContent-Length: 1", h) for n, h in enumerate(PAYLOADS)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("payload", F.lit(1))
    path = str(tmp_path / "archive")
    warc.write_archives(warc.classified(pages.coalesce(1)), path)
    for split in ("128m", "4k"):  # with small splits every record of the file meets its candidates elsewhere
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)
        read = warc.read_archives(spark, path, lambda body: {"body": body}).collect()
        got = {int(r["record_id"][10:-1]): (r["record_type"], r["refers_to"], bytes(r["body"])) for r in read}
        assert len(read) == len(rows)
        first = {}
        for i, _, h in rows:
            raw = (h or "").encode()
            kind = "response" if first.setdefault(raw, i) == i else "revisit"
            assert got[i] == (kind, None if kind == "response" else f"<urn:page:{first[raw]}>", raw if kind == "response" else b"")
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    digests = {r["page_id"]: r["payload_digest"] for r in warc.classified(pages).collect()}
    assert digests == {i: base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode() for i, _, h in rows}


def test_no_archive_and_no_chain(spark, tmp_path):
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    warc.write_archives(warc.classified(empty), str(tmp_path / "none"))
    assert warc.read_archives(spark, str(tmp_path / "none"), lambda body: {"body": body}).count() == 0
    (tmp_path / "junk").mkdir()
    (tmp_path / "junk" / "a.warc").write_bytes(b"junk" + INNER.encode())  # nothing starts at offset 0
    assert warc.read_archives(spark, str(tmp_path / "junk"), lambda body: {"body": body}).count() == 0


def test_small_payloads_are_all_responses(spark):
    pages = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (None, "u", "abcd"), (4, "u", "abcd")], "page_id long, url string, html string")
    got = {r["page_id"]: (r["record_type"], r["refers_to"]) for r in warc.classified(pages, min_bytes=3).collect()}
    assert got == {1: ("response", None), 2: ("response", None), None: ("revisit", 4), 4: ("response", None)}


def _nearest(vectors, every, k):
    points = {i: np.array(v, float) for i, v in vectors}
    out = {}
    for i, v in points.items():
        if i % every == 0:
            near = sorted((float(np.sqrt(((v - w) ** 2).sum())), j) for j, w in points.items() if j != i)
            out[i] = [(j, s) for s, j in near[:k]]
    return out


def test_neighbours_are_exact_on_a_small_table(spark):
    rnd = np.random.default_rng(2)
    vectors = [(i, rnd.normal(size=8).astype("f4").tolist()) for i in range(300)]
    vectors += [(300 + i, vectors[0][1]) for i in range(150)]  # one hot vector
    odd = [(1000, None), (1100, [0.0] * 8), (1200, [float("nan")] * 8), (1300, [1.0] * 7 + [None]), (1400, [float("inf")] * 8), (1500, [1.0, 2.0]), (None, [1.0] * 8)]
    frame = spark.createDataFrame(vectors + odd, "vec_id long, embedding array<float>").withColumns({c: F.lit(1) for c in ("vec", "point", "leaf", "query")})
    got = {}
    for r in ann_forest.nearest(frame).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(got[r["query_id"]])
    assert got == _nearest(vectors, 100, 10)
    assert ann_forest.nearest(frame.limit(0)).count() == 0
    few = ann_forest.nearest(spark.createDataFrame(vectors[:3], "vec_id long, embedding array<float>")).collect()
    assert len(few) == 2


def test_every_dimension_is_searched(spark):
    """A large dimension with a forest, a small one, one of a single vector; ids that repeat over dimensions."""
    rnd = np.random.default_rng(6)
    many = [(i, v) for i, v in enumerate(rnd.normal(size=(5_000, 3)).tolist())]
    few = [(100 * i, v) for i, v in enumerate(rnd.normal(size=(12, 2)).tolist(), 100)]
    frame = spark.createDataFrame([*many, *few, (20_000, [1.0])], "vec_id long, embedding array<double>").repartition(4)
    got = {}
    for r in ann_forest.nearest(frame).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    want = _nearest(few, 100, 10)
    assert {q: got[q] for q in want} == want and 20_000 not in got
    near = _nearest(many, 100, 10)
    assert set(got) == set(want) | set(near)
    assert sum(len({i for i, _ in got[q]} & {i for i, _ in near[q]}) for q in near) >= 0.95 * 10 * len(near)
    pair = [(100, [1.0, 2.0, 3.0]), (101, [1.0, 2.0, 4.0]), *((i, [float(i), 1.0]) for i in range(1, 8))]
    found = ann_forest.nearest(spark.createDataFrame(pair, "vec_id long, embedding array<double>")).collect()
    assert [tuple(r) for r in found] == [(100, 1, 101, 1.0)]


def test_recall(spark):
    rnd = np.random.default_rng(4)
    vectors = [(i, v) for i, v in enumerate(rnd.normal(size=(12_000, 32)).astype("f4").tolist())]
    frame = spark.createDataFrame(vectors, "vec_id long, embedding array<float>").repartition(8)
    got = {}
    for r in ann_forest.nearest(frame, every=400).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    points = np.array([v for _, v in vectors], float)
    hits = 0
    for q, found in got.items():
        d = ((points - points[q]) ** 2).sum(axis=1)
        d[q] = np.inf
        hits += len(found & set(np.argsort(d)[:10].tolist()))
    assert len(got) == 30 and hits >= 0.9 * 300


def test_cells_over_several_columns_stay_apart():
    assert html_text.visible_text("<table><tr><td colspan=2>Alpha<td colspan=2>Beta</table>") == "Alpha  Beta"


def test_a_scan_that_is_split_otherwise_is_read_again(spark, tmp_path, monkeypatch):
    """Split sizes change between the two scans: no record is lost."""
    pages = spark.createDataFrame([(n, "u", f"<p>{n}{INNER}" + "x" * 500) for n in range(60)], "page_id long, url string, html string")
    path = str(tmp_path / "archive")
    warc.write_archives(warc.classified(pages.coalesce(1)), path)
    found, pieces = [], warc._pieces

    def changing(*args):
        found.append(pieces(*args))
        return found[-1]

    def linked(parsed, link=warc._linked):
        made = warc.materialize(link(parsed))
        # as if executors had come since: the second scan of the first try has other splits, as all later ones
        spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
        return made

    monkeypatch.setattr(warc, "_pieces", changing)
    monkeypatch.setattr(warc, "_linked", linked)
    try:
        read = warc.read_archives(spark, path, lambda body: {"body": body}).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len(found) == 2
    assert sorted(bytes(r["body"]).decode() for r in read) == sorted(r["html"] for r in pages.collect())
