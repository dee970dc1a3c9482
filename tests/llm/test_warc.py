import zlib

import pytest

from compare import compare, connect
from raceflow.llm import warc
from raceflow.llm.catalog import QUERIES, SQL
from raceflow.registry import Entry
from raceflow.session import scratch_path


@pytest.mark.parametrize("size", ["sf0.001", "sf0.01"])
def test_matches_sql(spark, size):
    sf = f"/root/testdata/{size}"
    name = "op8_capture_index"
    problem, rows = compare(spark, connect(sf), Entry(name, QUERIES[name], SQL[name], ""), sf)
    assert problem == "" and rows > 0


def test_url_keys():
    assert warc.url_key("http://www.a.example.org:80/x?y#z") == "org,example,a)/x?y"
    assert warc.url_key("https://user@Host.com:8080") == "com,host:8080)/"
    assert warc.url_key(None) == "~" and warc.url_key("") == ")/"
    assert "\n" not in warc.url_key("http://a.b/c\td\ne") and "\t" not in warc.url_key("http://a.b/c\td")
    assert warc.sort_key("http://a/", None) < warc.sort_key("http://a/", -5) < warc.sort_key("http://a/", 3)


def test_records_and_lookup(spark):
    rows = [(i, f"http://h{i % 5}.example.org/p{i // 50}", f"<p>{i % 90} ü</p>") for i in range(400)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    folder = scratch_path(spark, "warc")
    captures = warc.write(pages, folder, archive_bytes=3_000)
    directory = warc.index(captures, folder, block_lines=7)
    assert directory.count() >= 400 // 7
    every = captures.collect()
    assert len(every) == 400 and len({r["archive"] for r in every}) > 3
    wanted = [warc.sort_key(rows[i][1], i) for i in (0, 17, 399)] + ["zz,missing)/ 1", "  before all"]
    keys = spark.createDataFrame([(k,) for k in wanted], "key string")
    found = warc.lookup(keys, folder, directory, 2)
    assert sorted(r["key"] for r in found.collect()) == sorted(wanted[:3])
    assert sorted(r["page_id"] for r in warc.read(found, folder).collect()) == [0, 17, 399]
    one = next(r for r in every if r["key"] == warc.sort_key(rows[399][1], 399))
    place = folder.removeprefix("file://")
    raw = open(f"{place}/{one['archive']}", "rb").read()[one["at"]:one["at"] + one["length"]]
    assert "<p>39 ü</p>".encode() in zlib.decompress(raw, 31)


def test_lookup_by_url_and_host(spark):
    """One host has most of the pages; every URL and host against a scan of all captures."""
    urls = ["http://a.example.org/x", "https://www.a.example.org/x#y", "http://a.example.org:8080/x", "http://b.a.example.org/", "http://aa.example.org/x",
            "http://a.example.organic/x", "http://example.org/a", None, "http://a.example.org/x/y"]
    rows = [(i, urls[i % len(urls)] if i % 3 else "http://hot.example.org/p%d" % (i % 40), f"<p>{i}</p>") for i in range(900)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    folder = scratch_path(spark, "warc")
    directory = warc.index(warc.write(pages, folder), folder, block_lines=7)

    def found(values, hosts):
        asked = spark.createDataFrame([(v, 1) for v in values], "url string, low int")
        captures = warc.captures_in(warc.ranges_of(asked, "url", hosts), folder, directory)
        return sorted(r["page_id"] for r in warc.read(captures, folder).collect())

    for url in [*urls, "http://hot.example.org/p3", "http://none.org/"]:
        key = warc.url_key(url)
        assert found([url, url], False) == [i for i, u, _ in rows if warc.url_key(u) == key], url
    assert found(urls, False) == [i for i, u, _ in rows if u in urls]

    def under(host):
        names = [(i, (u or "").split("://")[-1].split("/")[0].removeprefix("www.").split(":")[0]) for i, u, _ in rows]
        return [i for i, n in names if n == host or n.endswith("." + host)]

    for host in ("a.example.org", "hot.example.org", "example.org", "b.a.example.org", "org", "le.org"):
        assert found([host, None], True) == under(host), host
    assert found(["a.example.org", "example.org"], True) == under("example.org")
    assert found([], True) == [] and under("org")


def test_common_payload_is_split(spark, monkeypatch):
    from raceflow import skew
    rows = [(i, f"http://h/{i}", "common" if i % 3 == 0 else f"own {i // 4}") for i in range(300)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    plain = sorted(map(tuple, warc.round_trip(pages).collect()))
    monkeypatch.setattr(skew, "BROADCAST_BYTES", 64)
    spark.conf.set("spark.raceflow.hotRows", "50")
    try:
        assert sorted(map(tuple, warc.round_trip(pages).collect())) == plain
    finally:
        spark.conf.unset("spark.raceflow.hotRows")
    assert {r[4] for r in plain if r[0] % 3 == 0} == {297, None}


def test_awkward(spark):
    rows = [(1, None, None, 5), (2, "", "", 5), (3, "http://a b/\n", "x" * 300_000, 5), (4, "http://a/", "same", 5),
            (4, "http://a/", "same", 5), (9, "http://a/", "same", 5), (None, "http://n/", "same", 5), (7, "http://7/", "other", 5)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, digest int")
    got = sorted((r["page_id"] or 0, r["payload_bytes"], r["record_type"], r["refers_to"]) for r in warc.round_trip(pages).collect())
    assert got == [(0, 4, "response", None), (1, 0, "revisit", 2), (2, 0, "response", None), (3, 300_000, "response", None),
                   (4, 4, "revisit", 9), (4, 4, "revisit", 9), (7, 5, "response", None), (9, 4, "response", None)]
    assert warc.round_trip(pages.limit(0)).collect() == []
    damaged = bytearray(warc.record(1, "http://a/", b"payload", None))
    damaged[-1] ^= 1
    with pytest.raises(Exception):
        warc.parsed(bytes(damaged))
