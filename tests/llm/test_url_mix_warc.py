import base64
import gzip
import hashlib
import json
import re
import urllib.parse

import pytest
from pyspark.sql import functions as F

from granary.llm import mixing, url_filter, warc
from granary.session import scratch


def brute_url(url, rules=url_filter.RULES):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h + p), len(h), v == "block", h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[3], best[4] if best else "allow"


URLS = [None, "", "no scheme.org/", "://", "http://", "http://ORG/", "http://org", "http://a.org?x", "https://x.example.org/es/1", "https://notexample.org/es/1", "http://example.org/en/12#f", "http://example.org/en", "http://a.com/fr/", "http://a.com/de/", "http://com/de/x", "http://a.com//de/", "http://u@a.com:80/fr/", "x://y://example.org/es/", "http://exämple.org/", "http://a..org/", "http://.org/", "http://" + "a." * 5000 + "org/" + "p" * 50000]


def test_url_rules(spark):
    rows = [(i if i % 5 else None, u, "x", "y") for i, u in enumerate(URLS + URLS[:9])]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, host string, rule string")
    got = sorted((tuple(r) for r in url_filter.judge(pages).collect()), key=str)
    assert got == sorted(((r[0], *brute_url(r[1])) for r in rows), key=str)
    assert url_filter.judge(pages.limit(0)).count() == 0
    more = [("block", "example.org", ""), ("allow", "example.org", ""), ("block", "Org", "/e")]
    rules = [(v, h.lower(), p) for v, h, p in more]
    got = sorted((tuple(r) for r in url_filter.judge(pages, more).collect()), key=str)
    assert got == sorted(((r[0], *brute_url(r[1], rules)) for r in rows), key=str)
    assert {r["verdict"] for r in url_filter.judge(pages, [], default="block").collect()} == {"block"}


def test_mix_meets_targets(spark):
    rows, k = [], 0
    for source, n in [("b", 400), ("a", 50), (None, 300), ("ü", 3), ("c", 900), ("empty", 4)]:
        for i in range(n):
            rows.append((k, None if source == "empty" else "w " * (1 + (k * 37) % 200), source, 1))
            k += 1
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, size int")
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows)
    again = mixing.mix(docs.repartition(7)).collect()
    key = lambda r: str((r["source"], r["doc_id"], r["taken"]))
    assert sorted(got, key=key) == sorted(again, key=key)
    # water level by hand: shares by weight, capped ones fixed, until none is above
    names = ["a", "b", "c", "empty", "ü", None]
    size = {s: sum(r["size"] for r in got if r["source"] == s) for s in names}
    weight = dict(zip(names, [5, 2, 1, 5, 2, 1], strict=True))
    left, open_, target = float(sum(size.values())), set(names), {}
    while True:
        level = left / sum(weight[s] for s in open_) if open_ else 0
        over = {s for s in open_ if weight[s] * level > 3 * size[s]}
        if not over:
            break
        for s in over:
            target[s] = 3.0 * size[s]
            left -= target[s]
        open_ -= over
    target |= {s: weight[s] * level for s in open_}
    for s in names:
        mine = [r for r in got if r["source"] == s]
        assert all(r["source_size"] == size[s] and abs(r["target"] - target[s]) < 1e-6 and 0 <= r["copies"] <= 3 for r in mine)
        assert abs(sum(r["taken"] for r in mine) - target[s]) <= max((r["size"] for r in mine), default=0) / 2 + 1e-6
    copies = {(r["doc_id"], r["copies"]) for r in got if r["size"]}
    want, _ = brute_mix([(r["doc_id"], r["text"], r["source"]) for r in docs.collect()], target)
    assert {r["doc_id"]: r["copies"] for r in got} == want
    # the callers' columns stay, whatever their names
    more = docs.selectExpr("*", "1 AS u", "2 AS copies", "3 AS col", "4 AS row", "5 AS digits", "6 AS target", "7 AS _copies")
    out = mixing.mixed(more)
    assert out.columns == more.columns and out.agg({"col": "min", "copies": "max"}).first() == (3, 2)
    n = {r["doc_id"]: r["n"] for r in out.groupBy("doc_id").agg(F.count("*").alias("n")).collect()}
    assert {(d, n.get(d, 0)) for d, _ in copies} == copies


def brute_mix(rows, target, seed="mix", cap=3):
    """id -> copies and id -> expected copies, source by source: rates by bisection, the whole order sorted."""
    out, hopes = {}, {}
    for source in {s for _, _, s in rows}:
        mine = [(k, len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))) for k, t, s in rows if s == source]
        low, high = 0.0, 10.0
        hope = lambda n, rate: min(float(cap), rate * len(f"{n:b}"))
        for _ in range(200):
            mid = (low + high) / 2
            low, high = (mid, high) if sum(n * hope(n, mid) for _, n in mine) < target[source] else (low, mid)
        expected = {k: hope(n, high) for k, n in mine}
        certain = {k: int(e + 1e-9) for k, e in expected.items()}
        left = target[source] - sum(certain[k] * n for k, n in mine)
        ranked = []
        for k, n in mine:
            p = expected[k] - certain[k]
            if p > 1e-9:
                u = (int(hashlib.sha256(f"{seed}:{k}".encode()).hexdigest()[:13], 16) + 0.5) / (1 << 52)
                ranked.append((u / (1 - u) * (1 - p) / p, k, n))
        ranked.sort()
        while ranked and ranked[0][2] <= left + 1e-6:
            _, k, n = ranked.pop(0)
            certain[k] += 1
            left -= n
        if ranked:
            _, _, k, n = min((abs(left - n), at, k, n) for at, k, n in ranked)
            certain[k] += abs(left - n) < left
        out |= certain
        hopes |= expected
    return out, hopes


def test_mix_probabilities_differ_and_hold(spark):
    """Longer documents are taken more often; over many seeds each as often as its expected copies say."""
    rows = [(k, "w " * (1 + 7 * k % 400), "ab"[k % 3 == 0]) for k in range(240)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    got = {r["doc_id"]: r for r in mixing.mix(docs).collect()}
    target = {r["source"]: r["target"] for r in got.values()}
    total, times = dict.fromkeys(got, 0), 400
    for seed in range(times):
        copies, hopes = brute_mix(rows, target, f"s{seed}")
        for k, n in copies.items():
            total[k] += n
    assert all(abs(got[k]["expected"] - hopes[k]) < 1e-9 for k in got)
    assert len({round(hopes[k] % 1, 6) for k in got if rows[k][2] == "a"}) > 4
    assert max(abs(total[k] / times - hopes[k]) for k in got) < 0.12
    assert abs(sum(total[k] / times - hopes[k] for k in got)) < 0.02 * len(got)
    again = mixing.mix(docs, seed="s7").collect()
    assert {r["doc_id"]: r["copies"] for r in again} == brute_mix(rows, target, "s7")[0]


def test_mix_edge_rows(spark):
    schema = "doc_id bigint, text string, source string"
    assert mixing.mix(spark.createDataFrame([], schema)).count() == 0
    rows = [(None, None, None), (None, "", "a"), (1, "x y", "a"), (1, "x y", "a"), (2, "z " * 30000, None)]
    got = mixing.mix(spark.createDataFrame(rows, schema)).collect()
    assert len(got) == 5 and all(r["taken"] <= 3 * r["size"] for r in got)
    assert all(r["taken"] == 0 for r in mixing.mix(spark.createDataFrame([(1, None, "a")], schema)).collect())


PAGES = [(5, "http://a/", "<p>é</p>"), (3, "http://b/\r\nX: y", "<p>é</p>"), (None, None, "<p>é</p>"), (9, "u", None), (8, "u", ""), (7, "http://x", "q" * 900_000), (3, "http://b/\r\nX: y", "<p>é</p>"), (12, "http://z", "a\r\n\r\nWARC/1.1\r\n\r\n"), (11, "http://z", "once")]


def test_archives_round_trip(spark):
    pages = spark.createDataFrame([(*p, 1) for p in PAGES], "page_id bigint, url string, html string, file int")
    root = scratch(spark, "test-warc")
    files = warc.archive(pages.coalesce(2), root)
    got = [tuple(r) for r in warc.read_archives(files, f"{root}/members").collect()]
    payload = {k: (h or "").encode() for k, _, h in PAGES}
    assert sorted(map(str, (r[0] for r in got))) == sorted(str(p[0]) for p in PAGES)
    for page, n, digest, kind, refers in got:
        data = payload[page]
        assert n == len(data) and digest == base64.b32encode(hashlib.sha1(data).digest()).decode()
        same = [k for k, v in payload.items() if v == data and k is not None]
        assert (kind == "response") == (refers is None)
        assert refers in (None, min(same, default=None))
    by = sorted((r[0] if r[0] is not None else -1, r[3]) for r in got)
    assert by == [(-1, "revisit"), (3, "response"), (3, "revisit"), (5, "revisit"), (7, "response"), (8, "response"), (9, "revisit"), (11, "response"), (12, "response")]
    # every record is a member of its own, at the offset that the sidecar states
    local = urllib.parse.urlparse(root).path + "/members"
    for r in files.collect():
        data = open(f"{local}/{r['file']}", "rb").read()
        entries = [json.loads(x) for x in open(f"{local}/{r['file']}.idx")]
        assert [e["offset"] for e in entries] == [0, *[e["offset"] + e["length"] for e in entries]][: len(entries)]
        assert b"".join(gzip.decompress(data[e["offset"] : e["offset"] + e["length"]]) for e in entries) == gzip.decompress(data)
        assert r["n_records"] == len(entries) and r["n_bytes"] == len(data)
        assert entries[0]["type"] == "warcinfo" and [e["seq"] for e in entries] == [None, *range(len(entries) - 1)]
        ids = re.findall(rb"\r\nWARC-Record-ID: (\S+)", gzip.decompress(data))
        assert len(ids) == len(set(ids)) == len(entries)


def test_gzip_members_in_any_division(tmp_path):
    """The normaliser reads files of one member or many, and says so when a file ends too early."""
    record = lambda i: warc._head("response", warc._urn(i, "f.gz", i), "u", "X", len(body(i))) + body(i) + b"\r\n\r\n"
    body = lambda i: b"HTTP/1.1 200 OK\r\n\r\n" + b"x" * (i * 200_000)
    given = [warc._info("f.gz"), *map(record, range(4))]
    whole, n = b"".join(given), 0
    cuts = {"one": [whole], "each": given, "odd": [whole[:10], whole[10:400_001], whole[400_001:]]}
    for name, parts in cuts.items():
        data = b"".join(map(gzip.compress, parts)) + b"\0" * 512
        (tmp_path / name).write_bytes(data)
        assert warc._normalised(f"file://{tmp_path}/{name}", f"file://{tmp_path}/{name}.out", {})[0] == 5
        out = (tmp_path / f"{name}.out").read_bytes()
        assert gzip.decompress(out) == whole
        n += 1
    squeeze = warc.zlib.compressobj(6, warc.zlib.DEFLATED, 31)
    at_border = squeeze.compress(b"".join(given[:2])) + squeeze.flush(warc.zlib.Z_FULL_FLUSH)
    for name, data in {"cut": gzip.compress(whole)[:-9], "border": at_border, "record": gzip.compress(whole[:-1000]), "head": gzip.compress(whole + b"WARC/1.1\r\n"), "none": b"", "later": gzip.compress(whole) + gzip.compress(record(1))[:30]}.items():
        (tmp_path / name).write_bytes(data)
        with pytest.raises(ValueError):
            warc._normalised(f"file://{tmp_path}/{name}", f"file://{tmp_path}/{name}.out", {})
        assert not (tmp_path / f"{name}.out").exists()
    (tmp_path / "junk").write_bytes(gzip.compress(whole) + b"junk")
    with pytest.raises(warc.zlib.error):
        warc._normalised(f"file://{tmp_path}/junk", f"file://{tmp_path}/junk.out", {})


@pytest.mark.parametrize("least", [0, 1, 10])
def test_small_payloads_stay_responses(spark, least):
    pages = spark.createDataFrame(PAGES, "page_id bigint, url string, html string").filter("page_id IS NOT NULL")
    root = scratch(spark, "test-warc")
    got = warc.read_archives(warc.archive(pages, root, least), f"{root}/members").collect()
    assert all(r["record_type"] == "response" for r in got if r["payload_bytes"] < least)
    assert any(r["record_type"] == "revisit" for r in got) == (least < 10)


def test_no_pages(spark):
    pages = spark.createDataFrame([], "page_id bigint, url string, html string")
    root = scratch(spark, "test-warc")
    assert warc.read_archives(warc.archive(pages, root), f"{root}/members").count() == 0
