"""Subtrees, dealt groups and repeats of the substring operator against brute force."""

import random
import re

import numpy as np
import pytest

from siteloom.llm import substring_dedup


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def brute(rows, window=13):
    """(doc_id, text) -> (number of words, removed places)."""
    first = {}
    for i, t in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        w = words(t)
        for k in range(len(w) - window + 1):
            first.setdefault(tuple(w[k : k + window]), i)
    out = {}
    for i, t in rows:
        w = words(t)
        gone = np.zeros(len(w), dtype=bool)
        for k in range(len(w) - window + 1):
            if first[tuple(w[k : k + window])] != i:
                gone[k : k + window] = True
        out[i, t] = w, gone
    return out


@pytest.mark.parametrize("group", [1 << 18, 40])
def test_hot_passages_are_split_and_dealt(spark, docs, monkeypatch, group):
    monkeypatch.setattr(substring_dedup, "GROUP", group)
    monkeypatch.setattr(substring_dedup, "LEAST", group)
    rng = random.Random(20)
    prose = lambda n: " ".join(rng.choice("abcdefghijklmnop") + str(rng.randint(0, 40)) for _ in range(n))
    hot, warm = prose(30), prose(20)
    rows = [(i, f"{prose(10)} {hot}\n{prose(6)}" if i % 2 else f"{warm} {prose(9)} {warm if i % 4 else ''}") for i in range(120)]
    rows += [(500, hot + " " + prose(5))] * 40 + [(None, hot + " end"), (501, None), (502, ""), (503, " ".join(["same"] * 60)), (504, " ".join(["same"] * 30)), (505, rows[1][1])]
    # one prefix with very many ends
    rows += [(600 + i, "one two three four five six seven " + prose(8)) for i in range(120)]
    want = brute(rows)
    got = substring_dedup.dedup_substrings(docs(*[(*r, None, None) for r in rows])).collect()
    assert len(got) == len(rows)
    from collections import Counter

    have = Counter((r["doc_id"], r["n_words"], r["n_removed"], r["text"], tuple(map(tuple, r["repeats"]))) for r in got)
    should = Counter()
    for r in rows:
        w, gone = want[r]
        ends = np.flatnonzero(np.diff(np.concatenate([[0], gone, [0]]).astype(int))).tolist()
        should[r[0], len(w), int(gone.sum()), " ".join(x for x, g in zip(w, gone, strict=True) if not g), tuple((a, b - a) for a, b in zip(ends[::2], ends[1::2], strict=True))] += 1
    assert have == should


def test_prefixes_grow_where_a_bucket_is_full():
    w = np.random.default_rng(1).integers(0, 2**63, 40, dtype=np.uint64)
    at = np.arange(28)
    from siteloom.llm.common import windows

    mask = np.uint64(63)
    every = np.arange(64)
    assert substring_dedup.lengths(13) == [4, 7, 10, 13]
    rk = np.full(28, 25)
    none = substring_dedup.Splits(13, 64, {}, 10)
    key, dealt = none.keys(w, at, rk)
    assert (key == windows(w, 4, 1)[at]).all() and not dealt.any()
    full = substring_dedup.Splits(13, 64, {k: (every, np.full(64, 95)) for k in (4, 7, 10, 13)}, 10)
    key, dealt = full.keys(w, at, rk)
    other, _ = full.keys(w, at, rk + 1)
    again, _ = full.keys(w, at, rk + 10)
    assert dealt.all() and (key == again).all() and (key != other).all() and (key != windows(w, 13, 1)[at]).all()
    one = substring_dedup.Splits(13, 64, {4: ((windows(w, 4, 1)[3:4] & mask).astype(int), np.array([95]))}, 10)
    key, _ = one.keys(w, at, rk)
    assert key[3] == windows(w, 7, 1)[3]


def test_lcp():
    rows = np.zeros((4, 1 + 9 * 2 + 5), dtype=np.uint8)
    rows[2:, 5] = 1  # the third word differs
    rows[3, -1] = 1  # the window's hash alone differs
    assert substring_dedup.lcp(rows).tolist() == [0, 10, 2, 9]


@pytest.mark.parametrize("columns", [["rk", "whole", "starts"], ["__t0", "n_words", "part"]])
def test_clashing_names_and_empty_tables(spark, docs, columns):
    from pyspark.sql import functions as F

    df = docs((1, "a b c"), (2, None)).withColumns({c: F.lit(c) for c in columns})
    out = substring_dedup.dedup_substrings(df)
    rows = out.orderBy("doc_id").collect()
    assert [r["n_words"] for r in rows] == [3, 0] and all(r[c] == c for r in rows for c in columns if c != "n_words")
    assert substring_dedup.dedup_substrings(df.limit(0)).count() == 0
