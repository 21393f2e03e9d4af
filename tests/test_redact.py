import re

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from siteloom.functions import redact


def masked(spark, *texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r["x"] for r in df.select("i", redact.redact(F.col("t")).alias("x")).orderBy("i").collect()]


def test_steps(spark):
    got = masked(
        spark, "see https://a.b/c?x=1&y=2 now", "eyJab.eyJcd.ef", "id 0123456789abcdef ok", "short 0123456789abcde", "mail a.b@c.org!", "at 10.0.0.255 up", "v 1.2.3 no",
        "token=abcd", "token=abc", "password: true", 'secret: "hunter22"', "2001:db8:0:1:2:3:4:5", "key=123e4567-e89b-12d3-a456-426614174000", None,
    )
    assert got == [
        "see https://a.b/c now", "[REDACTED_JWT]", "id [REDACTED_HEX] ok", "short 0123456789abcde", "mail [REDACTED_EMAIL]!", "at [REDACTED_IP] up", "v 1.2.3 no",
        "token=[REDACTED]", "token=abc", "password: true", 'secret=[REDACTED]"', "[REDACTED_IP]", "key=[REDACTED_UUID]", None,
    ]


def test_map_drops_private_keys(spark):
    m = spark.range(1).select(redact.redact_map(F.create_map(F.lit("Private_note"), F.lit("a"), F.lit("note"), F.lit("mail a@b.org"))).alias("m")).first()["m"]
    assert m == {"note": "mail [REDACTED_EMAIL]"}


def test_likely_secret(spark):
    words = ["short", "sk-abcdefghijKL", "aB3-aB3-aB3-aB3-aB3-aB3-", "plainlowercase", "my_secret_key1"]
    got = [r["x"] for r in spark.createDataFrame([(w,) for w in words], "w string").select(redact.likely_secret(F.col("w")).alias("x")).collect()]
    assert got == [False, True, True, False, True]


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.from_regex(r"[a-z]{1,8}", fullmatch=True), st.from_regex(r"[a-z0-9]{1,8}", fullmatch=True), st.integers(0, 255)), min_size=1, max_size=6))
def test_nothing_personal_is_left(spark, parts):
    text = " ".join(f"{a}@{b}.org and {n}.{n}.1.2 there" for a, b, n in parts)
    out = masked(spark, text)[0]
    assert "@" not in out and not re.search(r"\d+\.\d+\.\d+\.\d+", out)
