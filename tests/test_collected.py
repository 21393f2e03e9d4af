"""Sitemaps nested and in cycles, numbering without a sort, scan logs of any length, files as they lie in a folder."""

import gzip
import random
import re
import urllib.parse
from collections import Counter

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from siteloom.operators import collected
from siteloom.plans import collected as plans
from siteloom.sources import files as readers

FILES = "run_id string, site string, sitemap_url string, body string"
STARTS = "run_id string, site string, pos int, ref string"


def index(*refs):
    return "<sitemapindex>" + "".join(f"<sitemap><loc>{r}</loc></sitemap>" for r in refs) + "</sitemapindex>"


def urlset(*urls):
    return "<urlset>" + "".join(f"<url><loc>{u}</loc></url>" for u in urls) + "</urlset>"


def queue(files, starts):
    """One file after the other, as a queue: (ref, depth) in the order in which they are taken, and the URLs."""
    bodies = {u: b for _, _, u, b in files}
    todo = [(r, 0) for *_, r in sorted(starts, key=lambda x: x[2])] + [(f"https://s/{p}", 0) for p in ("sitemap.xml", "sitemap_index.xml", "sitemap-index.xml")]
    seen, order, urls = set(), [], []
    while todo:
        ref, depth = todo.pop(0)
        if ref in seen:
            continue
        seen.add(ref)
        order.append((ref, depth))
        body = bodies.get(ref, "")
        todo += [(x.split("</loc>")[0], depth + 1) for x in body.split("<sitemap><loc>")[1:]]
        urls += [x.split("</loc>")[0] for x in body.split("<url><loc>")[1:]]
    return order, urls


def test_fifteen_levels_and_a_cycle(spark):
    files = [("r", "s", f"https://s/{i}.xml", index(f"https://s/{i + 1}.xml", f"https://s/gone{i}.xml", "https://s/0.xml", f"https://s/{i}.xml")) for i in range(15)]
    files.append(("r", "s", "https://s/15.xml", urlset("https://s/deep")))
    df, starts = spark.createDataFrame(files, FILES), spark.createDataFrame([("r", "s", 0, "https://s/0.xml")], STARTS)
    walk = collected.sitemap_walk(df, starts)
    assert [r["url"] for r in collected.numbered(walk).collect()] == ["https://s/deep"] and walk.agg(F.max("depth")).first()[0] == 15
    errors = {r["message"] for r in collected.sitemap_errors(walk, most=1).collect()}
    assert "https://s/gone14.xml: no such file" in errors and "Reached MAX_SITEMAP_URLS limit (1)" in errors and len(errors) == 15 + 3 + 1


def test_walk_is_a_queue(spark):
    rng = random.Random(3)
    names = [f"https://s/{i}.xml" for i in range(40)]
    files = []
    for i, n in enumerate(names[:36]):  # the others are not there
        body = index(*rng.sample(names, rng.randint(1, 6))) if rng.random() < 0.5 else urlset(*(f"https://s/{i}/{k}" for k in range(rng.randint(0, 9))))
        files.append(("r", "s", n, body))
    files.append(("r", "s", "https://s/sitemap.xml", index(names[7], names[3])))
    starts = [("r", "s", 4, names[20]), ("r", "s", 1, names[5]), ("r", "s", 6, names[5])]
    df, st = spark.createDataFrame(files, FILES).repartition(7), spark.createDataFrame(starts, STARTS)
    order, urls = queue(files, starts)
    walk = collected.sitemap_walk(df, st)
    assert [(r["ref"], r["depth"]) for r in walk.orderBy("depth", "path").collect()] == order
    for most in (50_000, len(urls) // 2, 1, len(urls)):
        got = collected.numbered(walk, most).orderBy("seq").collect()
        assert [r["url"] for r in got] == urls[:most] and [r["seq"] for r in got] == list(range(1, min(most, len(urls)) + 1))


def test_urls_of_a_site_are_not_sorted(spark):
    files = [("r", "s", "https://s/sitemap.xml", index(*(f"https://s/{i}.xml" for i in range(20))))] + [("r", "s", f"https://s/{i}.xml", urlset(*(f"https://s/{i}/{k}" for k in range(500)))) for i in range(20)]
    df = spark.createDataFrame(files, FILES)
    urls = collected.sitemap_urls(df, spark.createDataFrame([], STARTS))
    plan = urls._jdf.queryExecution().optimizedPlan().toString()
    # the window runs over counts of files; URLs are spread to rows after it
    assert plan.index("Generate posexplode") < plan.index("Window") and plan.count("Window [") == 1
    assert urls.count() == 10_000 and urls.where("seq = 501").first()["url"] == "https://s/1/0"


def test_robots_alone(spark):
    starts = spark.createDataFrame([("r", "lonely", 0, "https://lonely/x.xml")], STARTS)
    walk = collected.sitemap_walk(spark.createDataFrame([], FILES), starts)
    assert [r["message"] for r in collected.sitemap_errors(walk).collect()] == ["https://lonely/x.xml: no such file"] and collected.numbered(walk).count() == 0


def scan(text, most=100):
    """The whole text at once: cut, then line by line."""
    if len(text) > collected.SCANNED:
        text = text[: collected.SCANNED] + "\n... [truncated]"
    out = []
    for line in text.split("\n"):
        word = line.split(":")[0]
        if word in ("CRITICAL", "LOW", "INFO") and len(line) > len(word) + 2:
            out.append([word, line[len(word) + 1 :].strip(), ""])
        elif out:
            out[-1][2] += line + "\n"
    return [tuple(x) for x in out[:most]]


def test_scan_logs_of_any_length(spark):
    rng = random.Random(9)
    line = lambda: rng.choice(["CRITICAL: bad thing", "LOW: small", "INFO: x", "detail " * rng.randint(0, 30), "", "y" * 700])
    texts = {"short": "\n".join(line() for _ in range(50)), "edge": "\n".join(["INFO: e", "z" * (collected.SCANNED - 8)]), "over": "\n".join(["INFO: e", "z" * (collected.SCANNED - 7)]), "long": "\n".join(line() for _ in range(6000)), "none": "CRITICAL: only"}
    texts["one"] = "INFO: " + "w" * (2 * collected.SCANNED)
    rows = [("r", s, i, x) for s, t in texts.items() for i, x in enumerate(t.split("\n"))]
    got = collected.scan_findings(spark.createDataFrame(rows, "run_id string, site string, line_no long, line string").repartition(9)).collect()
    for site, text in texts.items():
        assert [(r["severity"], r["title"], r["description"]) for r in sorted((r for r in got if r["site"] == site), key=lambda r: r["no"])] == scan(text), site


def test_a_log_of_a_million_lines_spreads(spark):
    lines = spark.range(1_000_000).select(F.lit("r").alias("run_id"), F.lit("s").alias("site"), F.col("id").alias("line_no"), F.when(F.col("id") % 7 == 0, F.concat(F.lit("LOW: n"), "id")).otherwise("text").alias("line"))
    kept = collected.scanned_lines(lines)
    # what reaches a site's own window is bounded by characters, not by the log
    assert kept.count() < collected.SCANNED and kept.agg(F.sum(F.length("line"))).first()[0] <= collected.SCANNED + 20
    assert collected.scan_findings(lines).count() == 100
    assert kept.where("line = '... [truncated]'").first()["line_no"] == 1_000_000


def test_masks_stay(spark):
    df = spark.createDataFrame([("r", "s", 0, "INFO: token=abc"), ("r", "s", 1, "mail a@b.cd")], "run_id string, site string, line_no long, line string")
    r = collected.scan_findings(df).first()
    assert (r["title"], r["description"]) == ("token=[REDACTED]", "mail [EMAIL]\n")


def test_files_of_a_folder(spark, tmp_path):
    body = urlset("https://a.example/1", "https://a.example/é")

    def put(name, content, site="a.example"):
        folder = tmp_path / "in" / "run_id=r" / f"site={site}" / f"file={urllib.parse.quote(name, safe='')}"
        folder.mkdir(parents=True)
        (folder / "content").write_bytes(content)

    packed = gzip.compress(body.encode())
    put("sitemap.xml", body.encode())
    put("sitemap.xml.gz", packed)
    put("two-members.gz", gzip.compress(body[:40].encode()) + gzip.compress(body[40:].encode()))
    put("https://b.example/other.xml", b"\xef\xbb\xbf" + body.encode(), "b.example")
    put("called.xml", packed)  # what it is called does not matter
    put("empty.xml", b"")  # Spark lists no file without bytes
    put("short.gz", packed[:-9])
    put("broken.gz", b"\x1f\x8bxxxxxxxxxx")
    put("image.png", b"\x89PNG\x00\x00")
    put("bomb.gz", gzip.compress(b"a" * 200_000))
    put("large.xml", b"b" * 50_000)
    good, bad = readers.read_files(spark, str(tmp_path / "in"), stored=20_000, text=100_000)
    got = {r["sitemap_url"]: r["body"] for r in readers.sitemap_files(good).collect()}
    assert got == {"https://a.example/sitemap.xml": body, "https://a.example/sitemap.xml.gz": body, "https://a.example/two-members.gz": body, "https://b.example/other.xml": body, "https://a.example/called.xml": body}
    wrong = {urllib.parse.unquote(r["file"]): r["error"].split(":")[0] for r in bad.collect()}
    assert wrong == {"short.gz": "compressed file ends early", "broken.gz": "not readable as gzip", "image.png": "not a text file", "bomb.gz": "text exceeds 100000 bytes", "large.xml": "file exceeds 20000 bytes"}
    assert {r["compressed"] for r in good.where("file like '%two%'").collect()} == {True} and good.columns == ["run_id", "site", "file", "path", "body", "compressed"]
    found = collected.sitemap_urls(readers.sitemap_files(good), spark.createDataFrame([], STARTS))
    assert found.where("site = 'a.example'").count() == 2


def test_collected_files_are_dealt_by_number(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(plans, "scratch", lambda spark, name: str(tmp_path / name))
    plans.q_collected_files(spark, "/root/testdata/sf0.001").count()
    tasks = [re.match(r"part-(\d+)", p.name)[1] for p in tmp_path.rglob("part-*")]
    assert len(tasks) > 50 and max(tasks.count(t) for t in set(tasks)) < len(tasks) / 4


def test_collected_files_tell_what_is_wrong(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(plans, "scratch", lambda spark, name: str(tmp_path / name))
    out = plans.q_collected_files(spark, "/root/testdata/sf0.001")
    packed = next(tmp_path.rglob("part-*.gz"))
    packed.with_name(f".{packed.name}.crc").unlink()
    packed.write_bytes(packed.read_bytes()[:-9])
    errors = [r["error"] for r in out.where("error is not null").collect()]
    assert errors.count("compressed file ends early") == 1 and set(errors) == {"compressed file ends early", "not a text file"}
    assert out.where("(error is null) = (body_sha256 is null)").count() == 0


def test_collected_files_are_whole(spark, tmp_path):
    urls = [None, "", "/only/path", "https:///nohost", "https://a+b.example/", "https://sp ace.example/x", "https://ex%20am.example/q", "https://" + "日本" * 30 + ".example/", "https://big.example/" + "u" * (65 << 20)]
    pq.write_table(pa.table({"page_id": list(range(1, 28)), "url": [*urls, *urls[:-1], None, *urls[:-1], ""], "html": [""] * 27}), tmp_path / "pages.parquet")
    con = pytest.importorskip("duckdb").connect()
    con.execute(f"create view pages as select * from '{tmp_path}/pages.parquet'")
    want = con.execute(plans.ORACLE_SQL["collected_files"]).fetchall()
    # pages without a site and sites without a name have their files too, and no host is too long and no file too large
    assert Counter(map(tuple, plans.q_collected_files(spark, str(tmp_path)).collect())) == Counter(want) and {r[0] for r in want} > {None, "", "big.example"}
