"""The filter audit against one document at a time."""

import collections
import random
import re
from itertools import permutations

from siteloom.llm import filter_audit

R = random.Random(12)
BLANKS = r"[^\x20\x09-\x0D]+"


def failed(text, doc_id, rows):
    w = re.findall(BLANKS, text)
    return {
        "A": len(w) < 100,
        "B": 100 * len(set(w)) < 80 * len(w),
        "C": 100 * len(re.findall("[A-Z]", text)) > 10 * len(text),
        "D": re.search(r"[#$%&*|]", text) is not None,
        "E": doc_id is not None and any((t or "") == text and i is not None and i < doc_id for i, t, _ in rows),
    }


def brute(rows, labels):
    good, toxic = ({i for i, *x in labels if x[k] == 1 and i is not None} for k in (0, 1))
    out = collections.defaultdict(collections.Counter)
    for part in {lang or "" for _, _, lang in rows}:
        for order in permutations("ABCDE"):
            for s in range(5):
                out[part, "".join(order), s + 1].update({"kept": 0})
    for i, t, lang in rows:
        fails = failed(t or "", i, rows)
        for order in permutations("ABCDE"):
            gone = False
            for s, f in enumerate(order):
                c = out[lang or "", "".join(order), s + 1]
                c["unique_fails"] += fails[f] and sum(fails.values()) == 1
                if fails[f]:
                    c["redundant" if gone else "removed"] += 1
                    if not gone:
                        c["good_lost"] += i in good
                        c["toxic_lost"] += i in toxic
                    gone = True
                elif not gone:
                    c["kept"] += 1
    shapley = collections.Counter()
    for (part, order, s), c in out.items():
        shapley[part, order[s - 1]] += c["removed"]
    names = filter_audit.COUNTS
    return {k: (*(c[n] for n in names), shapley[k[0], k[1][k[2] - 1]]) for k, c in out.items()}


def text():
    n = R.choice([0, 3, 99, 100, 130, 400])
    words = [R.choice([f"w{R.randrange(1000)}", "again", "LOUD", "sp#t" if R.random() < 0.05 else "q"]) if R.random() < R.random() else f"v{k}" for k in range(n)]
    return R.choice([" ", "\n", "\t\x0b"]).join(words)


def test_against_one_document_at_a_time(spark, docs):
    texts = [text() for _ in range(25)] + ["", None, " \n ", "ÀÉ $", "A" * 300_000, " ".join(["x"] * 100), " ".join(map(str, range(100)))]
    rows = [(R.randrange(60), R.choice(texts), R.choice(["en", "de", None, ""])) for _ in range(120)]
    rows += rows[:5] + [(None, "no id", "en"), (None, "no id", "fr"), (3, "no id", "en"), (7, "hot", "en"), (7, "hot", "en"), (9, "hot", "de")] + [(i, "hot", "en") for i in range(100, 160)]
    labels = [(i, R.choice([0, 1, None]), R.choice([0, 1, None])) for i in range(40)] + [(4, 1, 0), (4, 0, 1), (None, 1, 1)]
    df = docs(*[(i, t, la, "s", "extra") for i, t, la in rows], schema="doc_id int, text string, lang string, quality string, mask string")
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = filter_audit.audit(df, table).collect()
    assert {(r["part"], r["filter_order"], r["step"]): (*(r[c] for c in filter_audit.COUNTS), r["shapley"]) for r in got} == brute(rows, labels)
    assert len(got) == 600 * len({r["part"] for r in got})


def test_empty_tables(spark, docs):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit(docs((1, "a")).limit(0), none).count() == 0
    assert {(r["part"], r["good_lost"]) for r in filter_audit.audit(docs((1, "a")), none).collect()} == {("", 0)}


def test_other_filters_fold_alike(spark):
    cell = spark.createDataFrame([("p", 0, 5, 1, 0), ("p", 1, 2, 0, 0), ("p", 3, 4, 2, 1)], "part string, mask int, n long, good long, toxic long")
    got = {(r["filter_order"], r["step"]): tuple(r[c] for c in filter_audit.COUNTS) + (r["shapley"],) for r in filter_audit.fold(cell, "AB").collect()}
    assert got == {("AB", 1): (5, 6, 0, 2, 2, 1, 8), ("AB", 2): (5, 0, 4, 0, 0, 0, 4), ("BA", 1): (7, 4, 0, 0, 2, 1, 4), ("BA", 2): (5, 2, 4, 2, 0, 0, 8)}
