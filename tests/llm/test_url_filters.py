from pyspark.sql import functions as F

from tidemark.llm import url_filters as U

DAY = 86_400


def test_intervals_and_precedence(spark):
    events = [("spam", "domain", "bad.com", False, "add", 10 * DAY), ("spam", "domain", "bad.com", False, "add", 12 * DAY), ("spam", "domain", "bad.com", False, "remove", 50 * DAY), ("spam", "domain", "bad.com", False, "add", 200 * DAY),
              ("ok", "host", "good.bad.com", True, "add", 0), ("spam", "prefix", "good.bad.com/ads", False, "add", 0), ("spam", "host", "x.org", False, "add", 5 * DAY), ("spam", "host", "x.org", False, "remove", 5 * DAY),
              ("spam", "host", None, False, "add", 1), ("ok", "prefix", "p.net/a/b", True, "add", 0), ("spam", "prefix", "p.net/a/b", False, "add", 0)]
    inter = U.validity_intervals(spark.createDataFrame(events + events[:3], "list string, kind string, value string, allow boolean, action string, at long"))
    assert {(r["value"], r["from"] // DAY, r["until"] and r["until"] // DAY) for r in inter.collect() if r["kind"] == "domain"} == {("bad.com", 10, 50), ("bad.com", 200, None)}
    caps = [(1, "http://www.bad.com/", 9 * DAY, "unlisted"), (2, "http://www.bad.com/", 10 * DAY, "blocked"), (3, "HTTPS://u@WWW.Bad.com:80/x?q", 49 * DAY, "blocked"), (4, "http://bad.com", 50 * DAY, "unlisted"), (5, "http://bad.com", 400 * DAY, "blocked"),
            (6, "http://good.bad.com/x", 20 * DAY, "allowed"), (7, "http://good.bad.com/ads/1", 20 * DAY, "blocked"), (8, "http://good.bad.com/adsx", 20 * DAY, "allowed"), (9, "http://x.org/", 6 * DAY, "blocked"), (10, "http://notbad.com/", 20 * DAY, "unlisted"),
            (11, None, 20 * DAY, "unlisted"), (12, "no url", 20 * DAY, "unlisted"), (13, "http://bad.com", None, "unlisted"), (2, "http://www.bad.com/", 10 * DAY, "blocked"), (14, "http://p.net/a//b/c", 1, "allowed")]
    df = spark.createDataFrame([(i, u, t, "k") for i, u, t, _ in caps], "id long, url string, at long, kind string")
    for cell in (U.CELL, DAY, 10_000 * DAY):
        got = [(r.id, r.verdict) for r in U.evaluate(df, inter, cell=cell).collect()]
        assert sorted(got) == sorted((i, v) for i, _, _, v in caps)


def test_no_entries(spark):
    none = U.validity_intervals(spark.createDataFrame([], "list string, kind string, value string, allow boolean, action string, at long"))
    assert [r.verdict for r in U.evaluate(spark.range(1).select("id", F.lit("http://a.b").alias("url"), F.lit(5).alias("at")), none).collect()] == ["unlisted"]
