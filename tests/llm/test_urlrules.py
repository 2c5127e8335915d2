import re

import pytest

from marlstone.llm import urlrules
from marlstone.llm.entries import RULES
from tests.tables import duck_rows, rows_of

URLS = [
    None, "", "nothing", "http://Example.ORG/es/x?y", "http://a.example.org/es", "https://example.org/en/1", "https://example.org/en/12#z", "http://example.com/de/1", "http://x.com/fr/",
    "http://com/de/", "http://xcom/de/", "http://b.net", "ftp://EXAMPLE.com?q=/de/", "http://org", "http://org/", "http://notexample.org/es/1", "x://y://com/de/", "http://é.com/de/é", "http:///de/",
    "http://a..com/de/", "http://com./de/", "http://user@com/de/", "http://com:80/de/", "http://w.com" + "/de/" + "a" * 5000, "http://com\n/de/x", "http://\x0b.org/",
]


def brute(url, rules=RULES, default="allow"):
    at = url.find("://") if url is not None else -1
    rest = url[at + 3 :] if at >= 0 else ""
    host = re.sub("[A-Z]", lambda m: m[0].lower(), re.match(r"[^/?#]*", rest)[0])
    path = re.match(r"[^?#]*", rest[len(host) :])[0] if at >= 0 else ""
    fits = [(len(h) + len(p), len(h), v == "block", h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[3], best[4] if best else default


def test_equals_brute_force(spark):
    df = spark.createDataFrame([(i, u, "a", "b") for i, u in enumerate(URLS + URLS)], "page_id int, url string, rule string, _rest string")
    out = urlrules.judged(df, urlrules.rule_table(spark, RULES))
    assert out.columns == ["page_id", "url", "_rest", "host", "path", "rule", "verdict"]
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in out.collect()}
    assert got == {i: brute(u) for i, u in enumerate(URLS + URLS)} and out.count() == 2 * len(URLS)


def test_precedence(spark):
    rules = [("com", "/", "allow"), ("a.com", "/", "block"), ("com", "/x/y", "allow"), ("b.a.com", "/x", "block"), ("a.com", "/x/", "allow")]
    urls = ["http://b.a.com/x/y", "http://a.com/x/", "http://a.com/", "http://q.com/x/y", "http://b.a.com/xq", "http://c.b.a.com/x/y"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id int, url string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in urlrules.judged(df, urlrules.rule_table(spark, rules), "block").collect()}
    assert got == {i: brute(u, rules, "block") for i, u in enumerate(urls)}


def test_no_pages_and_no_rules(spark):
    df = spark.createDataFrame([], "page_id int, url string")
    assert urlrules.judged(df, urlrules.rule_table(spark, RULES)).count() == 0
    one = spark.createDataFrame([(1, "http://com/de/")], "page_id int, url string")
    assert [r["verdict"] for r in urlrules.judged(one, urlrules.rule_table(spark, RULES).limit(0)).collect()] == ["allow"]


@pytest.mark.parametrize("name", ["op2_minhash_near_dedup", "op3_url_filters", "op4_embedding_near_dedup", "op6_warc_zip"])
def test_queries_equal_their_sql(spark, data, duck, name):
    from marlstone.llm import entries

    assert rows_of(entries.queries()[name](spark, data)) == duck_rows(duck, entries.oracle_sql()[name])
