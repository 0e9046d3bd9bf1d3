"""The query against its SQL and a plain form of the rules."""

from __future__ import annotations

import re

import duckdb
import pytest

from studyloom.llm import hosts
from studyloom.llm.queries import ORACLES, op9_host_reputation
from studyloom.session import table


def plain(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.split("[/?#]", rest, maxsplit=1)[0]
    path = re.split("[?#]", rest[len(host) :], maxsplit=1)[0]
    host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    best = None
    for verdict, h, p in hosts.RULES:
        if (host == h or host.endswith("." + h)) and path.startswith(p) and (best is None or len(h) + len(p) > best[0]):
            best = (len(h) + len(p), h + p, verdict)
    return host, path, best and best[1], best and best[2]


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_equals_sql(spark, sf):
    con = duckdb.connect()
    for t in ("pages", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/{sf}/{t}.parquet'")
    got = sorted(map(tuple, op9_host_reputation(spark, f"/root/testdata/{sf}").collect()))
    assert got == sorted(con.execute(ORACLES["op9_host_reputation"]).fetchall())
    urls = {r.page_id: r.url for r in table(spark, f"/root/testdata/{sf}", "pages").collect()}
    for page, host, path, rule, verdict in got:
        want = plain(urls[page])
        assert (host, path, rule) == want[:3] and verdict == (want[3] or verdict)


URLS = [None, "", "no scheme", "http://", "http://a.Net", "http://net/", "http://xnet/", "https://WWW.Example.NET/en/x?y#z", "ftp://example.com?/de/", "http://example.com/de/#", "http://b.example.com/de", "x://y.org/fr/a", "http://u:p@h.io:80/é?q://r", "a://b://c/d", "http://ÄA.org/FR/"]


def test_odd_pages(spark):
    pages = spark.createDataFrame([*((i, u, "h") for i, u in enumerate(URLS)), (3, URLS[3], "h"), (None, "http://n.io/", "h")], "page_id long, url string, host string")
    labels = spark.createDataFrame([(4, 0, 1), (4, 0, 1), (12, None, None), (None, 0, 1), (11, 1, 0)], "doc_id long, quality int, toxic int")
    for outcomes in (labels, labels.limit(0)):
        rows = hosts.judge(pages, outcomes).collect()
        assert len(rows) == len(URLS) + 2
        for r in rows:
            if r.page_id is not None:
                want = plain(URLS[r.page_id])
                assert (r.host, r.path, r.rule) == want[:3], URLS[r.page_id]
                assert r.verdict == (want[3] or r.verdict) and r.verdict in ("allow", "block")
    assert hosts.judge(pages.limit(0), labels).count() == 0


def test_bad_hosts_are_blocked(spark):
    pages = spark.createDataFrame([(i, f"http://{'bad' if i % 2 else 'good'}.io/{i}") for i in range(200)], "page_id long, url string")
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(0, 150)], "doc_id long, quality int, toxic int")
    said = {(r.host, r.verdict) for r in hosts.judge(pages, labels).collect()}
    assert said == {("bad.io", "block"), ("good.io", "allow")}


def test_registered_domains(spark):
    want = {
        "a.b.co.uk": ("co.uk", "b.co.uk"), "b.co.uk": ("co.uk", "b.co.uk"), "co.uk": ("co.uk", "co.uk"), "www.x.io": ("io", "x.io"), "io": ("io", "io"),
        "": ("", ""), "xco.uk": ("uk", "xco.uk"), "s3.some.cloud.example": ("some.cloud.example", "s3.some.cloud.example"),
    }
    hosts_of = spark.createDataFrame([(h,) for h in want], "host string")
    got = hosts_of.select("host", *hosts.suffix_and_domain(hosts_of.host, (*hosts.SUFFIXES, "some.cloud.example"))).collect()
    assert {h: (s, d) for h, s, d in got} == want


def test_neighbours_under_a_public_suffix_have_no_common_prior(spark):
    """Under co.uk, a bad site says nothing of others that a last-two-labels rule would take for its own pages."""
    sites = [("bad.co.uk", 1, 60), ("good.co.uk", 0, 60), ("new.good.co.uk", 0, 0), ("new.bad.co.uk", 1, 0)]
    pages, labels = [], []
    for host, toxic, n in sites:
        for _ in range(max(n, 1)):
            pages.append((len(pages), f"http://{host}/"))
            if n:
                labels.append((len(pages) - 1, 1, toxic))
    frame = hosts.with_parts(spark.createDataFrame(pages, "page_id long, url string"))
    mean = {r.host: r["mean"] for r in hosts.reputations(frame, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}
    assert mean["new.good.co.uk"] < 0.2 and mean["new.bad.co.uk"] > 0.8
