from __future__ import annotations

import datetime
import random

from pyspark.sql import functions as F

from spanloom.llm import urls

from .corpora import clashing

DAY = datetime.date(2024, 1, 1)


def _day(n):
    return DAY + datetime.timedelta(days=n)


def _host(url):
    rest = url.split("://", 1)[1] if "://" in url else ""
    rest = rest.split("/")[0].split("?")[0].split("#")[0]
    return rest.rsplit("@", 1)[-1].split(":")[0].rstrip(".").lower() or None


def test_hosts_and_keys(spark):
    rows = ["HTTP://User@WWW.Example.com:80/Path?q#f", "https://a.b.example.com.", "no url", None, "http:///x", "ftp://h", "http://x.org/a/b#c"]
    df = spark.createDataFrame([(u,) for u in rows], "url string")
    got = df.select("url", urls.host(F.col("url")).alias("h"), urls.keys(F.col("url")).alias("k")).collect()
    assert [r["h"] for r in got] == ["www.example.com", "a.b.example.com", None, None, None, "h", "x.org"]
    assert got[0]["k"] == ["domain:www.example.com", "domain:example.com", "domain:com", "url:www.example.com/Path"]
    assert got[6]["k"][-1] == "url:x.org/a/b"


def test_as_of_join_is_brute_force(spark):
    r = random.Random(4)
    names = ["a.com", "www.a.com", "x.www.a.com", "b.org", "c.b.org"]
    captures = [(i, None if r.random() < 0.05 else f"http://{r.choice(names)}/{r.choice('pq')}?x={i}", None if r.random() < 0.05 else _day(r.randint(0, 30))) for i in range(300)]
    captures += captures[:3]
    entries = [(r.choice(["spam", "adult"]), r.choice([f"domain:{r.choice(names)}", f"url:{r.choice(names)}/{r.choice('pq')}"]), _day(r.randint(0, 30)), r.random() < 0.6) for _ in range(80)]
    entries += entries[:4]
    cap = clashing(spark.createDataFrame(captures, "page_id long, url string, fetched date"))
    got = urls.filter_urls(cap, spark.createDataFrame(entries, "list string, key string, day date, added boolean")).collect()

    def active(name, key, day):
        own = [(d, added) for n, k, d, added in entries if (n, k) == (name, key) and d <= day]
        if not own:
            return False
        last = max(d for d, _ in own)
        return all(added for d, added in own if d == last)

    want = []
    for i, url, day in captures:
        found = []
        if url and day:
            labels = _host(url).split(".")
            keys = [f"domain:{'.'.join(labels[k:])}" for k in range(len(labels))] + [f"url:{_host(url)}/{url.split('/')[3].split('?')[0]}"]
            found = [n for n in ("adult", "spam") for k in keys if active(n, k, day)]
        want.append((i, bool(found), ",".join(sorted(set(found))), len(found)))
    assert sorted((x["page_id"], x["blocked"], x["lists"], x["n_entries"]) for x in got) == sorted(want)


def test_empty_tables(spark):
    cap = spark.createDataFrame([(1, "http://a.com/", DAY)], "page_id long, url string, fetched date")
    none = spark.createDataFrame([], "list string, key string, day date, added boolean")
    assert [r["blocked"] for r in urls.filter_urls(cap, none).collect()] == [False]
    assert urls.filter_urls(cap.filter(F.lit(False)), none).collect() == []
    assert urls.keep_clean(cap, none).count() == 1
