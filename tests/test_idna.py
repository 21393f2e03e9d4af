"""International hosts against the codec of another implementation."""

import random

from pyspark.sql import functions as F

from siteloom.functions import idna, urls
from siteloom.operators import page_signals
from siteloom.sources.tables import ascii_urls

#: Samples of RFC 3492, section 7.1 (fixed values).
SAMPLES = {
    "他们为什么不说中文": "ihqwcrb4cv8a8dqg056pqjye", "почемужеонинеговорятпорусски": "b1abfaaepdrnnbgefbadotcwatmq2g4l", "3年b組金八先生": "3b-ww4c5e180e575a65lsy2b", "-> $1.00 <-": "-> $1.00 <--", "ひとつ屋根の下2": "2-u9tlzr9756bt3uc0v",
}


def test_labels(spark):
    rng = random.Random(2)
    labels = [*SAMPLES, "ü", "üü", "a" * 40 + "é", "𝔞b", "😀x", "x", *("".join(rng.choice("abcäöüßéあいう中文字🙂-0") for _ in range(rng.randint(1, 24))) for _ in range(60))]
    got = {r["l"]: r["p"] for r in spark.createDataFrame([(x,) for x in labels], "l string").select("l", idna.punycode(F.col("l")).alias("p")).collect()}
    assert got == {x: x.encode("punycode").decode() for x in labels} and all(got[k] == v for k, v in SAMPLES.items())


def test_urls(spark):
    rows = [("https://Bücher.example:8080/ä?b#c", "https://xn--bcher-kva.example:8080/ä?b#c"), ("http://PLAIN.example/", "http://PLAIN.example/"), ("mailto:ü@x", "mailto:ü@x"), ("https://a。例え/", "https://a.xn--r8jz45g/")]
    df = spark.createDataFrame(rows, "url string, want string")
    assert all(r["url"] == r["want"] for r in ascii_urls(df).collect())
    normal = [r["n"] for r in df.select(urls.normalise(F.col("url")).alias("n")).limit(1).collect()]
    assert normal == ["https://xn--bcher-kva.example:8080/%C3%A4?b="]


def test_pages_and_links_meet(spark):
    html = '<a href="//bücher.example/x">a</a><a href="/y">b</a><a href="https://xn--bcher-kva.example/z">c</a>'
    pages = ascii_urls(spark.createDataFrame([("r", "s", 1, "https://BÜCHER.example/", 200, html)], "run_id string, site string, crawl_seq long, url string, status int, html string"))
    links = page_signals.page_links(pages).collect()
    assert len(links) == 3 and all(r["internal"] and r["link_url"].startswith("https://xn--bcher-kva.example/") for r in links)
