"""Each operator against brute force on small tables: nulls, empty and long texts, ties, repeated rows, clashing columns."""

import collections
import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from siteloom.llm import ann, byte_bpe, language_id, line_dedup, mixing, near_dedup, quality_rules, sharding, substring_dedup, toxicity
from siteloom.llm.components import components

WORDS = [f"w{i}" for i in range(300)]
R = random.Random(4)


def prose(n, rng=R):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


ODD = [(None, "no id here"), (1, None), (2, ""), (3, " \n\t "), (4, "Ünï cödé \U0001f600"), (5, "same row"), (5, "same row"), (6, "x" * 200_000)]


@pytest.mark.parametrize("keep_first", [False, True])
def test_line_dedup(spark, docs, keep_first):
    rows = [(i, "\n".join(["  COMMON line ", prose(3), "twice", "twice"] if i % 2 else [prose(4), "common LINE", ""])) for i in range(10, 40)] + ODD
    df = docs(*rows)
    got = collections.Counter((r["doc_id"], r["n_lines"], r["n_dropped"], r["text"]) for r in line_dedup.dedup_lines(df, keep_first=keep_first).collect())
    key = lambda line: line.strip(" \t\n\v\f\r").translate({c: c + 32 for c in range(65, 91)})
    where = collections.defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            where[key(line)].add((i, t))
    first_seen, want = set(), collections.Counter()
    for i, t in sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0)):
        lines = (t or "").split("\n")
        kept = []
        for line in lines:
            k = key(line)
            common = k != "" and len(where[k]) >= 10
            if not common or (keep_first and k not in first_seen):
                kept.append(line)
            if common:
                first_seen.add(k)
        want[i, len(lines), len(lines) - len(kept), "\n".join(kept)] += 1
    assert got == want
    assert line_dedup.dedup_lines(df.limit(0)).count() == 0


def test_line_dedup_leaves_the_session_as_it_was(spark, docs):
    from siteloom.llm.common import FEW_SAMPLES

    (name,) = FEW_SAMPLES
    before = spark.conf.get(name, None)
    line_dedup.dedup_lines(docs(*[(i, "a\nb %d" % i) for i in range(20)])).count()
    assert spark.conf.get(name, None) == before
    spark.conf.set(name, "77")
    try:
        line_dedup.dedup_lines(docs((1, "a"))).count()
        assert spark.conf.get(name) == "77"
    finally:
        spark.conf.unset(name)


def test_line_dedup_over_many_partitions(spark, docs):
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        df = docs(*[(i, "hot\nown %d" % i) for i in range(500)])
        assert {(r["n_dropped"], r["text"].startswith("own")) for r in line_dedup.dedup_lines(df).collect()} == {(1, True)}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def shingles(text):
    w = words((text or "").translate({c: c + 32 for c in range(65, 91)}))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def test_near_dedup(spark, docs):
    rows = []
    for g in range(12):
        base = prose(R.randint(5, 160)).split()
        for j in range(R.randint(1, 9)):
            own = list(base)
            for _ in range(R.randint(0, 4)):
                own[R.randrange(len(own))] = R.choice(WORDS)
            rows.append((len(rows) + 100, " ".join(own).upper() if j % 2 else "  ".join(own)))
    rows += [(7, "a b"), (8, "A  b"), (9, "a b c"), (1, None), (2, ""), (3, None)] + [(50, rows[0][1])] * 2
    sets = {i: shingles(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= 85 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    got = near_dedup.near_duplicates(docs(*rows)).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r["n_shingles"], r["component_id"], r["kept"]) == (len(sets[r["doc_id"]]), find(r["doc_id"]), find(r["doc_id"]) == r["doc_id"])
    assert near_dedup.keep_one(docs(*rows).withColumn("node", F.lit(1))).columns == ["doc_id", "text", "lang", "source", "node"]
    assert near_dedup.near_duplicates(docs(*rows).limit(0)).count() == 0


def test_sketch_estimates_jaccard():
    rng = np.random.default_rng(1)
    pool = np.unique(rng.integers(0, 2**63, 3000, dtype=np.uint64))
    a, b = near_dedup.registers(pool[:2000]), near_dedup.registers(pool[500:2500])
    c = near_dedup.chance(np.array([2000.0]), np.array([2000.0]))[0]
    assert 0 < c < 0.01 and abs(((a == b).mean() - c) / (1 - c) - 0.6) < 0.16


def test_components(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(0, 40)] + [(100, 101), (101, 102), (7, 7)], "u long, v long")
    got = {r["node"]: r["root"] for r in components(links).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 102: 100}


def waterfill(sizes, weights=(5, 2, 1), cap=3):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % 3] for i, s in enumerate(order)}
    total, target, free = sum(sizes.values()), {}, set(order)
    left = total
    while free:
        share = {s: left * w[s] / sum(w[x] for x in free) for s in free}
        over = {s for s in free if share[s] > cap * sizes[s]}
        if not over:
            return target | share
        for s in over:
            target[s] = cap * sizes[s]
            left -= target[s]
        free -= over
    return target


def test_mixing(spark, docs):
    rows = [(i, prose(R.randint(0, 60)), None, R.choice(["b", "a", None, "", "ä"])) for i in range(400)] + [(900, "one two", None, "tiny"), (901, None, None, "nothing")]
    df = docs(*rows)
    got = mixing.draw(df).collect()
    again = {(r["doc_id"], r["taken"]) for r in mixing.draw(df.repartition(7)).collect()}
    assert {(r["doc_id"], r["taken"]) for r in got} == again and len(got) == len(rows)
    sizes = collections.Counter()
    for _, t, _, s in rows:
        sizes[s] += len(words(t))
    target, taken = waterfill(sizes), collections.Counter()
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and abs(r["target"] - target[r["source"]]) < 1e-6 and r["taken"] <= 3 * r["size"] and r["taken"] == r["size"] * len(r["copies"])
        taken[r["source"]] += r["taken"]
    assert all(abs(taken[s] - target[s]) <= 30 for s in sizes)
    assert mixing.mix(df).count() == sum(len(r["copies"]) for r in got) and mixing.draw(df.limit(0)).count() == 0


def test_hypergeometric(spark):
    df = spark.range(4000).select(mixing.hypergeometric(F.lit(60), F.lit(25), F.lit(20), mixing._uniform(F.col("id"))).alias("x"))
    r = df.agg(F.avg("x"), F.var_pop("x"), F.min("x"), F.max("x")).first()
    assert abs(r[0] - 20 * 25 / 60) < 0.15 and abs(r[1] - 20 * 25 / 60 * 35 / 60 * 40 / 59) < 0.4 and r[2] >= 0 and r[3] <= 20


def test_split_tree_is_exact(spark):
    q = spark.createDataFrame([([10, 0, 7, 100],)], "q array<bigint>")
    leaves = [r["q"] for r in mixing.split_tree(q, 8, 3).collect()]
    assert np.array(leaves).sum(axis=0).tolist() == [10, 0, 7, 100] and {sum(x) for x in leaves} <= {14, 15}


def test_byte_bpe_round_trip_and_reference(spark, docs):
    tiktoken, public = pytest.importorskip("tiktoken"), pytest.importorskip("public_tokenizers")
    path = public.path("byte_bpe_50k.tiktoken")
    enc = tiktoken.Encoding("t", pat_str=public.PATTERN, mergeable_ranks=byte_bpe.codec(path).ranks, special_tokens={})
    alphabet = list("stremvldabSL''  \n\t1²é漢!? 　́😀")
    rows = [*ODD, *((100 + i, "".join(R.choice(alphabet) for _ in range(R.randint(0, 50)))) for i in range(300)), (999, "don't we'll I'LL 'sab x'' ''s 're <|endoftext|>")]
    got = byte_bpe.decode(byte_bpe.encode(docs(*rows), path), path).collect()
    texts = {(r["doc_id"], r["text"]): r for r in got}
    for i, t in rows:
        ids = enc.encode_ordinary(t or "")
        r = texts[i, t]
        assert r["ids"] == ids and r["n_tokens"] == len(ids) and r["decoded"] == (t or "")
        assert r["ids_sha256"] == hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest() and r["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()
    assert byte_bpe.encode_digests(docs(*rows), path).count() == len(rows)


def test_scan_equals_one_step_at_a_time():
    codes = np.random.default_rng(2).choice(byte_bpe._CODES, 5000)
    state, out = 0, []
    for c in codes.tolist():
        state = (c >> (2 * state)) & 3
        out.append(state)
    assert (byte_bpe.scan(codes) & 3).tolist() == out


def test_sharding(spark, docs):
    rows = [(i, prose(R.randint(0, 9))) for i in range(1000)] + ODD + [(5000 + i, "copy") for i in range(400)]
    got = sharding.shard_documents(docs(*rows).withColumn("cell", F.lit(1))).collect()
    assert len(got) == len(rows)
    by = collections.defaultdict(list)
    for r in got:
        by[r["shard"]].append(r["slot"])
    counts = [len(x) for x in by.values()]
    assert set(by) == set(range(24)) and max(counts) - min(counts) <= 1 and all(sorted(x) == list(range(len(x))) for x in by.values())
    assert sharding.shard_documents(docs(*rows).limit(0)).count() == 0


def test_toxicity(spark, docs):
    rows = [(i, prose(30) + (" you moron scum" if i % 4 == 0 else "")) for i in range(400)] + ODD
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(100, 400)] + [(None, 1), (7, None)], "doc_id long, toxic int")
    held = F.col("doc_id") % 5 == 0
    got = toxicity.score(docs(*rows), labels, held).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)
    fresh = [r for r in got if r["doc_id"] is not None and r["doc_id"] < 400 and r["doc_id"] > 6]
    assert sum(r["predicted"] == (r["doc_id"] % 4 == 0) for r in fresh) > 0.97 * len(fresh)
    assert {r["score"] for r in toxicity.score(docs(*rows), labels.limit(0), held).collect()} == {0.0}


def test_nearest_neighbours(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(600, 8)).astype(np.float32)
    x[100:160] = x[100]
    x[200] = 2 * x[201]
    rows = [(i, x[i].tolist()) for i in range(600)] + [(1000, None), (1050, [0.0] * 8), (1100, [float("nan")] * 8), (1150, [1.0] * 7 + [None]), (None, x[0].tolist())]
    got = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("vec_id") % 50 == 0).collect()
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    hit = 0
    for q in range(0, 600, 50):
        own = sorted((r["rank"], r["vec_id"], r["score"]) for r in got if r["query_id"] == q)
        s = u @ u[q]
        s[q] = -9
        best = sorted(range(600), key=lambda i: (-round(s[i], 12), i))[:5]
        assert [r[0] for r in own] == [1, 2, 3, 4, 5] and all(abs(s[i] - v) < 1e-12 for _, i, v in own)
        hit += len(set(best) & {r[1] for r in own})
    assert hit >= 0.9 * 60 and {r["query_id"] for r in got} == set(range(0, 600, 50))


def test_substring_dedup(spark, docs):
    shared = prose(40)
    rows = [(i, f"{prose(20)} {shared if i % 3 == 0 else ''} {prose(15)}\n{prose(5)}") for i in range(60)] + ODD
    rows += [(70, rows[0][1]), (71, rows[0][1]), (72, prose(30) + " " + rows[3][1][:200]), (73, " ".join(["a"] * 50)), (74, " ".join(["a"] * 20))]
    first = {}
    for i, t in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        w = words(t)
        for k in range(len(w) - 12):
            first.setdefault(tuple(w[k : k + 13]), i)
    got = {(r["doc_id"], r["text"]): r for r in substring_dedup.dedup_substrings(docs(*rows)).withColumn("l", F.lit(0)).collect()}
    for i, t in rows:
        w = words(t)
        gone = [False] * len(w)
        for k in range(len(w) - 12):
            if first[tuple(w[k : k + 13])] != i:
                gone[k : k + 13] = [True] * 13
        left = " ".join(a for a, b in zip(w, gone, strict=True) if not b)
        assert (i, left) in got and (got[i, left]["n_words"], got[i, left]["n_removed"]) == (len(w), sum(gone)), i
    assert substring_dedup.dedup_substrings(docs(*rows).limit(0)).count() == 0


def test_quality_rules(spark, docs):
    rng = random.Random(8)
    rows = [(i, prose(rng.randint(60, 400), rng), "en", "s") for i in range(400)]
    rows += [(1000 + i, " ".join(f"w{rng.randint(0, 999)}###" for _ in range(100)), "en", "s") for i in range(8)]
    rows += [(2000, "too short", None, None), (2001, "a b c d e f " * 20, "en", None), (2002, None, None, "s"), (2003, "x y z w\n" * 3 + prose(300), "en", "s")] + [(i and 5000 + i, t, None, None) for i, t in ODD]
    got = quality_rules.judge(docs(*rows)).collect()
    assert len(got) == len(rows)
    for r in got:
        t = next(t for i, t, *_ in rows if i == r["doc_id"])
        w = words(t)
        grams = collections.Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        cover = {p for k in range(len(w) - 4) if grams[tuple(w[k : k + 5])] > 1 for p in range(k, k + 5)}
        lines = [x for x in (t or "").split("\n") if words(x)]
        want = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(cover))
        assert tuple(r[c] for c in quality_rules.STATS) == want
        assert r["base_failed"] == (len(w) < 10 or 100 * len(cover) > 20 * len(w)) and not (r["base_failed"] and r["kept"])
    verdict = {r["doc_id"]: r["kept"] for r in got}
    assert all(verdict[i] for i in range(400)) and not any(verdict[1000 + i] for i in range(8))
    plan = quality_rules.judge(docs(*rows[:60]))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert quality_rules.judge(docs(*rows).limit(0)).count() == 0


def test_language_id(spark, docs):
    rng = random.Random(9)
    sounds = {"xx": ["ba", "lo", "mi", "tu"], "yy": ["schr", "eit", "ung", "öl"]}
    rows = [(i, " ".join("".join(rng.choice(sounds[s]) for _ in range(3)) for _ in range(rng.randint(2, 40))), s) for i in range(300) for s in [("xx", "yy")[i % 2]]]
    rows += [(900, None, "xx"), (901, "12 ...", "xx"), (902, "", None), (903, "ЖЖЖ", None)]
    got = {r["doc_id"]: r for r in language_id.predict(docs(*rows), F.col("doc_id") % 3 == 1).collect()}
    assert all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 for i in (900, 901, 902)) and got[903]["lang_pred"] in sounds
    assert sum(got[i]["lang_pred"] == rows[i][2] for i in range(300)) > 295 and all(0 <= r["score"] <= 1 for r in got.values())
    assert {r["lang_pred"] for r in language_id.predict(docs((1, "abc")), F.lit(False)).collect()} == {"und"}


def test_pipeline_stages(spark, docs):
    import corpus_pipeline

    rng = random.Random(10)
    rows = [(i, "shared head line\n" + prose(rng.randint(20, 60), rng), "en", f"s{i % 2}", 0) for i in range(60)]
    rows += [(100 + i, rows[i][1] + " tail", "en", "s0", 0) for i in range(3)]
    df = docs(*rows, schema="doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        df = stage(spark, df, None)
        assert df.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
    assert df.where("doc_id >= 100").count() == 0 and df.where(F.col("text").contains("shared head")).count() == 0
    out = corpus_pipeline.tokens(spark, df, None).collect()
    assert out and all(r["n_tokens"] == len(r["ids"]) for r in out)


def test_pipeline_links_near_copies_from_0_8(spark, docs):
    import corpus_pipeline

    rng = random.Random(12)
    rows = []
    for g in range(20):
        base = [f"g{g}x{i}" for i in range(104)]
        own = list(base)
        own[50] = "changed"
        own[rng.randint(60, 90)] = "again"
        rows += [(2 * g, " ".join(base)), (2 * g + 1, " ".join(own))]  # 90 of 110 shingles: 0.818
        low = [f"low{g}x{i}" for i in range(104)]
        rows += [(1000 + 2 * g, " ".join(low)), (1001 + 2 * g, " ".join("changed" if i in (30, 50, 70) else w for i, w in enumerate(low)))]  # 85 of 115: 0.739
    for a, b in zip(rows[::2], rows[1::2], strict=True):
        both = len(shingles(a[1]) & shingles(b[1])) / len(shingles(a[1]) | shingles(b[1]))
        assert 0.8 <= both < 0.85 if a[0] < 1000 else both < 0.8
    kept = {r["doc_id"] for r in corpus_pipeline.near(spark, docs(*rows), None).collect()}
    assert kept == {2 * g for g in range(20)} | {1000 + i for i in range(40)}


def test_language_id_counts_all_rows_and_samples_documents_once(spark, docs):
    rows = [(i, f"common word{i % 7}", "xx") for i in range(300)] + [(500 + i, f"common rare{'qz'[i % 2]}", "yy") for i in range(50)]
    rows += [(7, "hot row", "xx")] * 100 + [(None, "no id", "xx")] * 3 + [(900, "12 ...", "xx")]
    want = np.zeros(language_id.DIM + 1)
    for _, t, _ in rows:
        if raw := language_id.letters(t):
            want += np.append(language_id.grams(raw) > 0, True)
    known = docs(*rows).select("doc_id", "text", "lang")
    assert (language_id.frequencies(known) == want).all()
    found = [(r["lang"], r["doc_id"], r["text"]) for r in language_id.sampled(known, 2000).collect()]
    assert sorted(found, key=str) == sorted({(lang, i, t) for i, t, lang in rows}, key=str)
    few = collections.Counter(r["lang"] for r in language_id.sampled(known, 40).collect())
    assert few == {"xx": 40, "yy": 40}
    # the weights of a model do not depend on the sample
    idf = np.log((1 + want[-1]) / (1 + want[:-1])).astype(np.float32) + np.float32(0.1)
    model = language_id.learn(docs(*rows), sample=10)
    assert {m[0] for m in model} == {"xx", "yy"} and all((m[1][1] == idf).all() for m in model)


def test_nearest_neighbours_of_many_equal_queries(spark, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK", 64)
    sizes, in_blocks = [], ann.in_blocks

    def seen(queries):
        out = in_blocks(queries)
        sizes.extend(r["count"] for r in out.groupBy("block").count().collect())
        return out

    monkeypatch.setattr(ann, "in_blocks", seen)
    # 1000 queries over three distinct vectors
    df = spark.createDataFrame([(i, [[1.0, 0.0], [0.0, 1.0], [1.0, 1.0]][i % 3]) for i in range(1000)], "vec_id long, embedding array<float>")
    got = ann.nearest(df, F.lit(True)).collect()
    assert sum(sizes) == 1000 and max(sizes) <= 2 * 64
    per = collections.defaultdict(list)
    for r in got:
        per[r["query_id"]].append((r["rank"], r["vec_id"]))
    assert len(per) == 1000
    for q, own in per.items():
        assert sorted(own) == list(enumerate([i for i in range(q % 3, 1000, 3) if i != q][:5], 1))
