"""Dated URL lists."""

import datetime

from strandweave.llm import url_lists

D = datetime.date
ENTRIES = [
    (D(2021, 1, 1), "bad.org", "block", "x"), (D(2021, 6, 1), "bad.org", "remove", "x"), (D(2022, 1, 1), "bad.org", "block", "y"), (D(2021, 2, 1), "ok.bad.org", "allow", "z"),
    (D(2021, 1, 1), "Host.net/a/b", "block", "p"), (D(2021, 1, 1), "same.org", "allow", "a"), (D(2021, 1, 1), "same.org", "block", "b"), (None, "never.org", "block", "n"), (D(2021, 1, 1), None, "block", "n"),
]
CASES = [
    ("http://bad.org/x", D(2020, 12, 31), 0), ("http://bad.org/x", D(2021, 1, 1), 1), ("https://u:p@www.BAD.org:80/x", D(2021, 5, 31), 1), ("http://bad.org", D(2021, 6, 1), 0), ("http://bad.org", D(2023, 1, 1), 1),
    ("http://ok.bad.org", D(2021, 1, 15), 1), ("http://ok.bad.org", D(2021, 3, 1), 0), ("http://a.ok.bad.org?q", D(2022, 3, 1), 0), ("http://notbad.org", D(2021, 2, 1), 0), ("http://host.net/a/b/c", D(2022, 1, 1), 1),
    ("http://host.net/a/bc", D(2022, 1, 1), 0), ("http://host.net/a", D(2022, 1, 1), 0), ("http://same.org", D(2022, 1, 1), 1), ("http://never.org", D(2022, 1, 1), 0), ("not a url", D(2022, 1, 1), 0), ("", D(2022, 1, 1), 0),
    (None, D(2022, 1, 1), 0), ("http://bad.org", None, 0),
]


def _run(spark, cases, entries):
    captures = spark.createDataFrame([(i, u, t, "clash") for i, (u, t, _) in enumerate(cases)], "page_id long, url string, fetched date, pattern string")
    return url_lists.judge(captures, spark.createDataFrame(entries, "dated date, pattern string, action string, category string"))


def test_cases_by_broadcast_and_by_shuffle(spark, monkeypatch):
    for most in (url_lists.BROADCAST_ROWS, 0):
        monkeypatch.setattr(url_lists, "BROADCAST_ROWS", most)
        got = {r.page_id: r.blocked for r in _run(spark, CASES, ENTRIES).collect()}
        assert got == {i: want for i, (_, _, want) in enumerate(CASES)}


def test_patterns_of_any_depth(spark):
    day = D(2021, 1, 1)
    entries = [(day, "deep.org", "block", "h"), (day, "deep.org/a/b/c", "allow", "p"), (day, "deep.org/a/b/c/d/e/f", "block", "q"), (day, "page.net/1/2/3", "block", "r")]
    cases = [("http://deep.org/a/b", day, 1), ("http://deep.org/a/b/c", day, 0), ("http://deep.org/A/b/c/d/e?x", day, 0), ("http://deep.org/a/b/c/d/e/f/g/h", day, 1), ("http://deep.org/a/b/cc", day, 1), ("http://page.net/1/2/3/4", day, 1), ("http://page.net/1/2", day, 0), ("http://page.net", day, 0)]
    for few in (entries, entries[:1]):
        got = {r.page_id: r.blocked for r in _run(spark, cases, few).collect()}
        assert got == ({i: want for i, (_, _, want) in enumerate(cases)} if len(few) > 1 else {i: int("deep" in u) for i, (u, _, _) in enumerate(cases)})


def test_repeated_rows_and_empty_tables(spark):
    captures = spark.createDataFrame([(1, "http://bad.org", D(2022, 5, 1))] * 3 + [(None, None, None)] * 2, "page_id long, url string, fetched date")
    entries = spark.createDataFrame(ENTRIES, "dated date, pattern string, action string, category string")
    assert sorted(r.blocked for r in url_lists.judge(captures, entries).collect()) == [0, 0, 1, 1, 1]
    assert url_lists.judge(captures.limit(0), entries).count() == 0
    assert {r.blocked for r in url_lists.judge(captures, entries.limit(0)).collect()} == {0}
