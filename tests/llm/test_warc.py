import re

import duckdb
from pyspark.sql import functions as F

from panelscope.llm import warc

NASTY = "x\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nContent-Length: 2\r\n\r\nhi\r\n\r\nWARC/1.1\r\nbroken"


def pages_of(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def test_round_trip_with_magic_in_payloads(spark, tmp_path):
    rows = [(i, f"http://h/{i}", f"page {i} é") for i in range(200)]
    rows += [(300, "u\r\nX: y", NASTY), (301, None, NASTY), (302, "u", None), (303, "u", ""), (304, "u", "\r\n\r\n"), (305, "u", "漢" * 300_000), (7, "u", "again"), (None, "u", "no id")]
    path = f"{tmp_path}/w"
    warc.write(pages_of(spark, rows).withColumn("digest", F.lit(1)), path, archive_bytes=200_000)
    got = warc.read_archives(spark, path).collect()
    assert len(got) == len(rows) and len({r.path for r in got}) > 2
    want = sorted(((i, (h or "").encode()) for i, _, h in rows), key=str)
    last = {}
    for i, p in want:
        last[p] = max(last.get(p, -1), -1 if i is None else i)
    for r in got:
        p = next(p for i, p in want if i == r.id and (warc.digest(p) == r.payload_digest))
        assert r.payload_bytes == len(p)
        assert (r.type, r.refers) == (("response", None) if (-1 if r.id is None else r.id) == last[p] else ("revisit", last[p]))
        assert bytes(r.payload) == (p if r.type == "response" else b"")
    assert sorted(((r.id, r.payload_digest) for r in got), key=str) == sorted(((i, warc.digest(p)) for i, p in want), key=str)


def test_archives_of_skewed_sizes_stay_small(spark, tmp_path):
    import os

    rows = [(i, "u", f"{i} " + "a" * (100 if i % 50 else 20_000)) for i in range(2000)] + [(5000 + i, "u", str(i) * 100_000) for i in range(3)]
    path = f"{tmp_path}/w"
    warc.write(pages_of(spark, rows).coalesce(1), path, archive_bytes=60_000)
    sizes = sorted(os.path.getsize(f"{path}/{f}") for f in os.listdir(path) if f.startswith("part-"))
    assert len(sizes) > 20 and sizes[-4] < 70_000 and all(100_000 < x < 101_000 for x in sizes[-3:])  # the three long pages alone
    assert sorted(r.id for r in warc.read_archives(spark, path).collect()) == sorted(i for i, *_ in rows)


def test_urls_with_blanks_and_control_signs(spark, tmp_path):
    urls = ["http://h/a b\tc", "http://h/\r\nWARC-Type: x", "http://h/a%20b", "http://h/é", "\x7f\x00"]
    warc.write(pages_of(spark, [(i, u, "p") for i, u in enumerate(urls)]), f"{tmp_path}/w")
    got = {r.id: r.url for r in warc.read_archives(spark, f"{tmp_path}/w").collect()}
    assert got == {0: "http://h/a%20b%09c", 1: "http://h/%0D%0AWARC-Type:%20x", 2: "http://h/a%20b", 3: "http://h/é", 4: "%7F%00"}


def test_least_size(spark, tmp_path):
    warc.write(pages_of(spark, [(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcd"), (4, "u", "abcd")]), f"{tmp_path}/w", least=3)
    got = {r.id: (r.type, r.refers) for r in warc.read_archives(spark, f"{tmp_path}/w").collect()}
    assert got == {1: ("response", None), 2: ("response", None), 3: ("revisit", 4), 4: ("response", None)}


def test_chain_equals_a_walk(spark):
    steps = [("a", i * 10, (i + 1) * 10) for i in range(77)] + [("a", 15, 20), ("a", 35, 47), ("b", 5, 9), ("c", 0, 3), ("c", 3, 8), ("c", 4, 8), ("c", 8, 99)]
    got = sorted(tuple(r) for r in warc.reachable(spark.createDataFrame(steps, "path string, offset long, next long")).collect())
    assert got == sorted([("a", i * 10) for i in range(77)] + [("c", 0), ("c", 3), ("c", 8)])


def test_query_equals_sql(spark):
    d = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{d}/pages.parquet'")
    got = warc.op8_warc(spark, d)
    assert sorted(tuple(r) for r in got.collect()) == sorted(con.execute(warc.SQL).fetchall())
    assert got.columns == [c[0] for c in con.description]


def test_empty(spark, tmp_path):
    warc.write(pages_of(spark, []), f"{tmp_path}/w")
    assert warc.read_archives(spark, f"{tmp_path}/w").count() == 0
    assert re.fullmatch("[A-Z2-7]{32}", warc.digest(b""))
