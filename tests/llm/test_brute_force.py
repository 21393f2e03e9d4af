"""Ring walk, features, centroids, determinants, misses and bounds, each reckoned again in the plainest way."""

import collections
import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from siteloom.llm import ann, byte_bpe, language_id, line_dedup, mixing, near_dedup, quality_rules, sharding, toxicity

CLASHES = ["rk", "node", "key", "sketch", "band", "bitmap", "held_out", "margin", "shard", "epoch", "order_key", "block", "order", "ids", "g", "salt", "t0", "at", "sid", "copies", "size", "n_lines", "starts", "whole"]


def prose(rng, n):
    return " ".join(rng.choice("abcdefghij") + rng.choice("aeiou") + str(rng.randint(0, 50)) for _ in range(n))


def test_ring_walk_one_row_at_a_time(spark, docs):
    rng = random.Random(3)
    rows = [(i, prose(rng, rng.randint(0, 9))) for i in range(500)] + [(7000 + i, None) for i in range(5)]
    df = docs(*rows)
    shards, nodes = 6, 16
    at = {(r["doc_id"], r["text"]): r["at"] for r in df.select("doc_id", "text", F.xxhash64("doc_id", F.col("text").isNull(), "text").alias("at")).collect()}
    ring = spark.range(shards * nodes).select((F.col("id") % shards).alias("s"), F.xxhash64(F.lit("node"), "id").alias("at")).collect()
    cell = lambda x: (x % (1 << 64)) >> (64 - sharding.CELL_BITS)
    places = sorted((cell(r["at"]), (r["at"] % (1 << 64)) >> 1, r["s"]) for r in ring)
    assert len(places) == shards * nodes
    room = [len(rows) // shards + (s < len(rows) % shards) for s in range(shards)]
    used, want = [0] * shards, {}
    for key in sorted(at, key=lambda k: (cell(at[k]), at[k])):
        i = next((j for j, p in enumerate(places) if p[0] >= cell(at[key])), 0)
        while used[places[i][2]] == room[places[i][2]]:
            i = (i + 1) % len(places)
        s = places[i][2]
        want[key[0]] = (s, used[s])
        used[s] += 1
    import zlib

    for r in sharding.shard_documents(df, shards, nodes).collect():
        text = next(t for i, t in rows if i == r["doc_id"]) or ""
        assert (r["shard"], r["slot"]) == want[r["doc_id"]]
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(text.encode()) + 8, zlib.crc32(text.encode()), "rows", None)


def test_places_in_one_cell_all_stay(spark):
    cells = spark.createDataFrame([(0, 1)], "cell int, n long")
    assert sharding._places(cells, 24, 64).count() == 24 * 64


def test_toxicity_features(spark):
    lexicon = {"scum": 3.0, "moron": 2.5, "dull": 1.0}
    rng = random.Random(6)
    vocabulary = ["scum", "SCUM!", "m0r0n", "sc*um", "moron", "dull", "you", "your", "quite", "soooo", "Fine", "what?", "wow!!", "plain"]
    for _ in range(200):
        text = " ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 25)))
        got = dict(zip(toxicity.FEATURES, toxicity.features(text, lexicon), strict=True))
        raw = text.split()
        bare = [w.lower().strip("!\"#%&'()*+,-./:;<=>?[\\]^`{|}~") for w in raw]
        n = max(len(raw), 1)
        plain = [i for i, w in enumerate(bare) if lexicon.get(w, 0) >= 2]
        hidden = [i for i, w in enumerate(bare) if w in ("m0r0n", "sc*um")]
        second = [i for i, w in enumerate(bare) if w in ("you", "your")]
        hits = plain + hidden
        near = sum(any(abs(i - j) <= toxicity.NEAR for j in second) for i in hits)
        assert math.isclose(got["lexicon_density"], 100 * len(hits) / n) and math.isclose(got["hidden_density"], 100 * len(hidden) / n) and math.isclose(got["near_second"], near / max(len(hits), 1))
        assert math.isclose(got["weak_density"], 100 * bare.count("dull") / n) and math.isclose(got["second_density"], 100 * len(second) / n)
        assert math.isclose(got["capitals"], sum(c.isupper() for c in text) / max(len(text), 1)) and math.isclose(got["exclaimed"], 100 * text.count("!") / n) and math.isclose(got["asked"], 100 * text.count("?") / n)
        assert math.isclose(got["drawn_out"], 100 * bare.count("soooo") / n) and math.isclose(got["shouted"], sum(w == "SCUM!" for w in raw) / n) and math.isclose(got["log_words"], math.log1p(len(raw)))


def test_toxicity_scores_rise_with_the_trees(spark, docs):
    rng = random.Random(8)
    rows = [(i, prose(rng, 20) + (" you scum moron" if i % 3 == 0 else "")) for i in range(300)] + [(900, None), (901, "")]
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(300)], "doc_id long, toxic int")
    got = {r["doc_id"]: r["score"] for r in toxicity.score(docs(*rows), labels, F.col("doc_id") % 5 == 0).collect()}
    bad, good = [got[i] for i in range(300) if i % 3 == 0], [got[i] for i in range(300) if i % 3]
    assert min(bad) > max(good) and got[900] == got[901] <= max(good)


def test_language_vectors_and_cosines(spark, docs):
    rng = random.Random(9)
    rows = [(i, " ".join(rng.choice(s) + rng.choice(s) for _ in range(rng.randint(3, 20))), lang) for i in range(60) for lang, s in [[("xx", ["ba", "lo", "mi"]), ("yy", ["schr", "ung", "ö"])][i % 2]]]

    def vector(text):
        raw = ("".join(c if c.isalpha() else " " for c in text.lower())).split()
        b = (" " + " ".join(raw) + " ").encode()
        out = [0.0] * language_id.DIM
        m = 0xFFFFFFFF
        for k in range(len(b) - 1):
            two = (b[k] * 0x9E3779B1 & m) ^ (b[k + 1] * 0x85EBCA77 & m)
            both = [two ^ 0x27D4EB2F]
            if k + 2 < len(b):
                both.append(two ^ (b[k + 2] * 0xC2B2AE3D & m))
            for h in both:
                h ^= h >> 15
                out[(h * 0x2C1B3C6D & m) >> 20] += 1
        return out

    vectors = {i: vector(t) for i, t, _ in rows}
    df_ = [1 + sum(v[k] > 0 for v in vectors.values()) for k in range(language_id.DIM)]
    idf = [math.log((1 + len(rows)) / d) + 0.1 for d in df_]
    weighted = {}
    for i, v in vectors.items():
        x = [math.sqrt(a) * w for a, w in zip(v, idf, strict=True)]
        norm = math.sqrt(sum(a * a for a in x))
        weighted[i] = np.array([a / norm for a in x])
    model = language_id.learn(docs(*rows), clusters=2)
    centres = [(lang, m[0]) for lang, m, _ in model]
    assert all(abs(np.linalg.norm(c) - 1) < 1e-5 for _, c in centres)
    for lang in ("xx", "yy"):  # every centroid is the direction of the mean of the texts nearest to it
        own = [c for name, c in centres if name == lang]
        nearest = {i: int(np.argmax([weighted[i] @ c for c in own])) for i, _, s in rows if s == lang}
        for k, c in enumerate(own):
            mean = np.mean([weighted[i] for i, j in nearest.items() if j == k], axis=0)
            assert mean @ c / np.linalg.norm(mean) > 0.99
    for r in language_id.predict(docs(*rows), F.lit(False), clusters=2).collect():
        cosines = [(float(weighted[r["doc_id"]] @ c), lang) for lang, c in centres]
        assert r["lang_pred"] == max(cosines)[1] and abs(r["score"] - max(cosines)[0]) < 1e-4


def mcd(x):
    """Regularised minimum covariance determinant from very many starts, and distances after reweighting."""
    n, p = x.shape
    h = (n + 1) // 2

    def moments(rows, factor):
        rho = max(quality_rules.SHARE, quality_rules.WEIGHT / (len(rows) + quality_rules.WEIGHT))
        c = np.cov(rows.T, bias=True) if len(rows) > 1 else np.zeros((p, p))
        return rows.mean(axis=0), (1 - rho) * factor * c + rho * np.eye(p)

    def distance(m, s):
        return np.einsum("ni,ij,nj->n", x - m, np.linalg.inv(s), x - m)

    rng, best = np.random.default_rng(0), None
    for k in range(120):
        m, s = (np.zeros(p), np.eye(p)) if k == 0 else moments(x[rng.choice(n, min(n, 6), replace=False)], 1.0)
        for _ in range(40):
            d = distance(m, s)
            m, s = moments(x[d <= np.sort(d)[h - 1]], quality_rules.consistency(0.5))
        det = np.linalg.slogdet(s)[1]
        if best is None or det < best[0] - 1e-12:
            best = det, m, s
    d = distance(*best[1:])
    return best[0], distance(*moments(x[d <= quality_rules.chi2_point(0.975, p)], quality_rules.consistency(0.975)))


def test_minimum_covariance_determinant_of_each_group(spark):
    rng = np.random.default_rng(12)
    rows, group = [], {}
    for g, n in ((1, 90), (2, 25), (3, 3)):
        x = rng.normal(size=(n, 5)) @ rng.normal(size=(5, 5)) * 0.7
        x[: n // 8] += 9
        group[g] = x
        rows += [(g, int(i % 4), int(g * 1000 + i), int(i), *map(float, v)) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "g long, salt int, doc_id long, rk long, " + ", ".join(f"t{i} double" for i in range(5)))
    for few in (True, False):
        estimate = quality_rules._concentrated(df, few, 30, 1e-9)
        dets = {r["g"]: r["det"] for r in estimate.collect()}
        final = quality_rules._reweighted(df, estimate, few)
        got = {r["doc_id"]: r["d2"] for r in quality_rules._distance(quality_rules._meet(df, final, few)).collect()}
        limit = quality_rules.chi2_point(0.999, 5)
        for g, x in group.items():
            det, want = mcd(x)
            assert det - 1e-6 <= dets[g] <= det + 0.35, (few, g)
            own = np.array([got[g * 1000 + i] for i in range(len(x))])
            assert np.mean((own > limit) == (want > limit)) >= 0.96 and np.corrcoef(np.log(own + 1), np.log(want + 1))[0, 1] > 0.97, (few, g)


def test_chi_squared():
    assert abs(quality_rules.chi2(4.351460191095529, 5) - 0.5) < 1e-12 and abs(quality_rules.chi2_point(0.999, 5) - 20.515) < 1e-3 and abs(quality_rules.chi2_point(0.95, 1) - 3.8415) < 1e-3


@pytest.mark.parametrize("n", [40, 100, 111, 250])
def test_sketches_miss_no_pair_at_the_threshold(n):
    rng = np.random.default_rng(n)
    least = []
    for _ in range(1500):
        pool = rng.integers(0, 2**64, n, dtype=np.uint64, endpoint=False)
        both = -(-85 * n // 100)
        half = (n - both) // 2
        a, b = np.sort(pool[: both + half]), np.sort(np.concatenate([pool[:both], pool[both + half :]]))
        x, y = near_dedup.registers(a), near_dedup.registers(b)
        assert near_dedup._likely(x[None], y[None], np.array([float(len(a))]), np.array([float(len(b))]), 0.85)[0]
        least.append((near_dedup.band_keys(x) == near_dedup.band_keys(y)).sum())
    assert min(least) >= 2


def test_lines_of_repeated_rows_are_not_held():
    names = ["h1", "h2", "doc_id", "rk", "pos", "n_lines"]
    rows = [(5, 5, 0, 0, p, 3) for p in range(3) for _ in range(50_000)] + [(5, 5, d, 0, 0, 1) for d in range(1, 9)]
    kinds = [pa.int64()] * 4 + [pa.int32()] * 2
    batches = [pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[i : i + 10_000], strict=True), kinds, strict=True)], names=names) for i in range(0, len(rows), 10_000)]
    out = [r for b in line_dedup._stream_runs(10, False)(iter(batches)) for r in b.to_pylist()]
    assert collections.Counter(r["state"] for r in out) == {line_dedup._OPEN: 11, line_dedup._EDGE: 1} and out[-1]["n_docs"] == 9


def test_empty_tables(spark, docs):
    import corpus_pipeline

    none = docs((1, "x")).limit(0)
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    path = corpus_pipeline.rank_file()
    assert byte_bpe.encode_digests(none, path).count() == 0 and toxicity.score(none, labels, F.lit(False)).count() == 0 and language_id.predict(none, F.lit(False)).count() == 0
    assert ann.nearest(spark.createDataFrame([], "vec_id long, embedding array<float>"), F.lit(True)).count() == 0
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, None).count() == 0


def test_clashing_names(spark, docs):
    import corpus_pipeline

    rng = random.Random(4)
    rows = [(i, prose(rng, 40), "en", "s") for i in range(30)] + [(30, rows_text := prose(rng, 30), "en", "s"), (31, rows_text + " more", "en", "s"), (32, None, None, None)]
    plain = docs(*rows)
    df = plain.withColumns({c: F.lit(f"own {c}") for c in CLASHES})
    same = lambda f: collections.Counter(map(tuple, f(plain).collect())) == collections.Counter(map(tuple, f(df).collect()))
    assert same(near_dedup.near_duplicates) and same(lambda d: mixing.draw(d).drop("copies")) and same(sharding.shard_documents) and same(lambda d: quality_rules.judge(d).drop("d2"))
    assert same(lambda d: byte_bpe.encode_digests(d, corpus_pipeline.rank_file())) and same(lambda d: language_id.predict(d, F.lit(False)))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, df, None)
        assert out.columns == df.columns, name
        first = out.select(*CLASHES).distinct().collect()
        assert [tuple(r) for r in first] == [tuple(f"own {c}" for c in CLASHES)], name
    tokens = corpus_pipeline.tokens(spark, df, None).select("ids", "input_ids", "rk").first()
    assert tokens["input_ids"] == "own ids" and tokens["rk"] == "own rk" and tokens["ids"]


def test_repeated_rows_are_taken_together(spark, docs):
    got = mixing.draw(docs(*([(1, "same words here again and again")] * 20 + [(2, "other")]))).collect()
    assert len(got) == 21 and len({r["taken"] for r in got if r["doc_id"] == 1}) == 1


def test_common_shingles_of_blocks(monkeypatch):
    monkeypatch.setattr(near_dedup, "COUNTED", 7)
    rng = np.random.default_rng(2)
    left, right = ([np.unique(rng.integers(0, 60, rng.integers(1, 30), dtype=np.uint32)) for _ in range(k)] for k in (9, 14))
    assert (near_dedup.common(left, right) == [[len(set(a) & set(b)) for b in right] for a in left]).all()
    assert (near_dedup.common([np.array([1], dtype=np.uint32)], [np.array([2], dtype=np.uint32)]) == 0).all()


def test_links_that_join_components():
    u, v = np.array([1, 1, 2, 5, 1]), np.array([2, 3, 3, 6, 6])
    keep = near_dedup._joining(u, v, u, v)
    assert {(int(u[i]), int(v[i])) for i in keep} == {(1, 2), (1, 3), (1, 6), (5, 6)}


def test_a_large_group_of_near_copies(spark, docs, monkeypatch):
    monkeypatch.setattr(near_dedup, "CHUNK", 2000)
    rng = random.Random(31)
    base = [f"w{i}" for i in range(90)]
    rows = []
    for i in range(120):
        own = list(base)
        for _ in range(rng.randint(0, 4)):
            own[rng.randrange(len(own))] = f"x{rng.randint(0, 60)}"
        rows.append((i, " ".join(own)))
    sets = {i: {tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for i, t in rows}
    root = {i: i for i in sets}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a in sets:
        for b in range(a):
            both = len(sets[a] & sets[b])
            if 100 * both >= 85 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.near_duplicates(docs(*rows)).collect()}
    assert got == {i: find(i) for i in sets}
