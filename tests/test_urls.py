import pytest
from pyspark.sql import functions as F

from siteloom.functions import urls


def one(spark, column, **values):
    return spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items())).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("given", "wanted"),
    [
        ("Example.COM/a/", "https://example.com/a"),
        ("https://x.y:443/", "https://x.y/"),
        ("http://x.y:80/a", "http://x.y/a"),
        ("https://x.y:8080/a", "https://x.y:8080/a"),
        ("https://x.y", "https://x.y/"),
        ("https://x.y/?b=1&a=2&a=1", "https://x.y/?a=2&a=1&b=1"),
        ("https://x.y/a#f", "https://x.y/a"),
        ("https://x.y/%41", "https://x.y/A"),
        ("https://x.y/a+b", "https://x.y/a+b"),
        ("https://x.y/a b", "https://x.y/a%20b"),
        ("https://x.y/é", "https://x.y/%C3%A9"),
        ("https://x.y/%zz", "https://x.y/%zz"),
        ("  https://x.y/a ", "https://x.y/a"),
        ("not a url", "not a url"),
    ],
)
def test_normalise(spark, given, wanted):
    assert one(spark, urls.normalise(F.col("u")), u=given) == wanted
    assert one(spark, urls.normalise(F.col("u")), u=wanted) == wanted


@pytest.mark.parametrize(
    ("ref", "wanted"),
    [
        ("x", "https://h.z/a/x"),
        ("./x", "https://h.z/a/x"),
        ("../x", "https://h.z/x"),
        ("/x", "https://h.z/x"),
        ("//o.p/x", "https://o.p/x"),
        ("?q", "https://h.z/a/b?q"),
        ("#f", "https://h.z/a/b?z=1#f"),
        ("..", "https://h.z/"),
        ("HTTP://O.p/Q", "http://o.p/Q"),
        ("é y", "https://h.z/a/%C3%A9%20y"),
        ("data:x", None),
    ],
)
def test_resolve(spark, ref, wanted):
    assert one(spark, urls.resolve(F.col("b"), F.col("r")), b="https://h.z/a/b?z=1", r=ref) == wanted


@pytest.mark.parametrize(
    ("typed", "wanted"),
    [(' "example.com" ', "https://example.com"), ("(http://a.b/c)", "https://a.b/c"), ("acme", "https://acme.com"), ("htp://a.b", "https://a.b"), ("https://https://a.b", "https://a.b"), ("a b.com", "https://ab.com"), ("", "")],
)
def test_clean(spark, typed, wanted):
    assert one(spark, urls.clean_input(F.col("u")), u=typed) == wanted


def test_link_key_ignores_case_slash_and_query(spark):
    rows = spark.createDataFrame([("https://A.b/x/",), ("http://a.b/x?y=1",), ("https://a.b:443/x#z",)], "u string").select(urls.link_key(F.col("u")).alias("k")).collect()
    assert {r["k"] for r in rows} == {"a.b/x"}
