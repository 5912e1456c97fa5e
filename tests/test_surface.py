"""Lines of gzip members against the plain reader, and the functions that SQL can name."""

import gzip
import random

import pytest

from palimpsest.functions import sql_names
from palimpsest.plans import job_queries
from palimpsest.sources import gzip_members


def members_of(pick, raw, most):
    """``raw`` cut anywhere, a gzip member for each part; some parts are empty."""
    out, at = [], 0
    while at < len(raw):
        n = pick.choice([0, 1, pick.randrange(1, most)])
        out.append(gzip.compress(raw[at : at + n], pick.choice([0, 1, 9])))
        at += n
    return out


@pytest.mark.parametrize("seed", range(6))
def test_lines_of_any_ranges_are_those_of_the_file(tmp_path, seed):
    pick = random.Random(seed)
    # Stored members hold the format's magic bytes as text.
    rows = ["".join(pick.choice(["abc", "é", "", " ", "\x1f", "日本" * 40]) for _ in range(pick.randrange(30))) for _ in range(400)]
    raw = "\n".join(rows).encode() + (b"" if seed % 2 else b"\n")
    raw = raw.replace(b" ", b"\x1f\x8b\x08 ") if seed > 2 else raw
    path = tmp_path / "a.gz"
    path.write_bytes(b"".join(members_of(pick, raw, 1500)))
    size = path.stat().st_size
    want = raw.decode("utf-8", "replace").removesuffix("\n").split("\n")
    for width in (size + 1, size // 2 + 1, 999, 64):
        got = [x for a in range(0, size, width) for x in gzip_members.lines(str(path), a, a + width)]
        assert [e for _, e in got if e] == [] and [v for v, _ in got] == want


def test_damaged_members_are_told(tmp_path):
    parts = [gzip.compress("".join(f"{k}-{j}\n" for j in range(300)).encode()) for k in range(6)]
    hurt = bytearray(parts[2])
    hurt[len(hurt) // 2] ^= 0xFF
    path = tmp_path / "b.gz"
    path.write_bytes(b"".join([*parts[:2], bytes(hurt), *parts[3:]]))
    got = list(gzip_members.lines(str(path), 0, 1 << 30))
    assert [e for _, e in got if e] == [f"damaged member at byte {len(parts[0]) + len(parts[1])}"]
    values = {v for v, e in got if e is None}
    assert {f"{k}-{j}" for k in (0, 1, 4, 5) for j in range(300)} <= values and {f"3-{j}" for j in range(1, 300)} <= values
    (tmp_path / "c.gz").write_bytes(b"no gzip at all")
    assert [e for _, e in gzip_members.lines(str(tmp_path / "c.gz"), 0, 100)] == ["no member at byte 0"]
    (tmp_path / "d.gz").write_bytes(b"")
    assert list(gzip_members.lines(str(tmp_path / "d.gz"), 0, 100)) == []


def test_source(spark, tmp_path):
    pick = random.Random(1)
    raw = "".join(f"line {k} {pick.random()}\n" for k in range(5000)).encode()
    (tmp_path / "a.gz").write_bytes(b"".join(members_of(pick, raw, 4000)))
    (tmp_path / "b.gz").write_bytes(gzip.compress(b"only\none"))
    gzip_members.register(spark)
    read = spark.read.format("gzip_members").option("split_bytes", 20_000).load(str(tmp_path))
    assert read.rdd.getNumPartitions() > 5
    plain = spark.read.text(str(tmp_path))
    assert sorted(r["value"] for r in read.collect()) == sorted(r["value"] for r in plain.collect())


def test_functions_by_name(spark):
    sql_names.register(spark)
    page = '<html><head><title>A</title><meta name="author" content="B"></head><body>text<img src="/x.png"></body></html>'
    spark.createDataFrame([(1, "https://example.org/p", page), (2, None, None)], "page_id long, url string, html string").createOrReplaceTempView("pages_")
    got = {r["page_id"]: tuple(r)[1:] for r in spark.sql("select page_id, e.* from pages_, lateral extract_page(url, html) e").collect()}
    assert got == {1: ("A", "B", None, "text", ["https://example.org/x.png"]), 2: (None, None, None, "", [])}
    post = '{"id": "p", "title": "T", "body": "b", "media": [{"url": "u"}, {"url": "v"}], "replies": [{"author": "x", "body": "r", "replies": [{"body": "s"}]}]}'
    spark.createDataFrame([(post,), ('{"id": "q", "body": "b"}',), ("broken",), (None,)], "raw string").createOrReplaceTempView("posts_")
    got = sorted(map(tuple, spark.sql("select e.* from posts_, lateral normalize_post(raw) e").collect()), key=str)
    assert got == [("p", "T\nb\nx: r\n?: s", 0, "u"), ("p", "T\nb\nx: r\n?: s", 1, "v"), ("q", "b", None, None)]
    r = spark.sql("select normalize_nfc('é') as n, geodesic_m(52.52D, 13.405D, 48.8566D, 2.3522D) as m").first()
    assert r["n"] == "é" and abs(r["m"] - 879_700) < 500


def test_dumps_are_made_by_many_tasks(spark, monkeypatch):
    """A narrow table is one split, so its lines are dealt by their number before they are made and compressed."""
    monkeypatch.setattr(job_queries, "ITEMS", 50)
    assert len(job_queries.dump(spark, "/root/testdata/sf0.001").inputFiles()) >= 4
    assert job_queries.rebuilt_items(spark, "/root/testdata/sf0.001").rdd.getNumPartitions() >= 4
