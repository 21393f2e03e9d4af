"""Quality by a generalised additive model with pairwise interactions.

Every feature has a lookup table over its bins, learned by boosting: in turn, feature by feature, a shallow tree over
one feature's bins is fitted to what is left to explain and a small share of it is added to that feature's table.  Then the pairs of
features that explain most of the rest get tables of their own in the same way.  Several bags of a
stated sample are boosted in tasks of their own and their tables averaged.  A text's score is the sum of the table
entries of its bins, for a whole batch at once.

Features are counted from the UTF-8 bytes of a whole batch of texts with array operations; no per-row Python runs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siteloom.llm.common import bounded_batches, materialise, mix

FEATURES = [
    "log_words", "word_length", "long_words", "single_words", "upper_share", "shouted_words", "digit_share", "symbol_share", "symbol_words", "pipe_share", "mark_share", "exclaimed", "stop_words",
    "distinct_words", "adjacent_repeats", "repeated_grams", "log_lines", "line_words", "repeated_lines", "ended_lines",
]
#: Bins of a feature, and of each side of a pair.
BINS, COARSE = 64, 16
#: Bytes of words hashed at once, and bytes of texts counted at once.
PIECE, TOGETHER = 1 << 22, 1 << 21

#: Bytes of each class; a byte's classes are the bits of its code.  "wide" bytes continue a code point.
_BYTES = {
    "blank": b"\t\n\x0b\x0c\r ", "upper": bytes(range(65, 91)), "lower": bytes(range(97, 123)), "digit": b"0123456789", "symbol": b"#$%&*|<>@^~=+_\\/{}[]`", "mark": b".,;:!?'\"()-", "stop": b".!?",
    "wide": bytes(range(128, 192)),
}
_BIT = {name: 1 << i for i, name in enumerate(_BYTES)}
_CODE = np.array([sum(_BIT[name] for name, held in _BYTES.items() if i in held) for i in range(256)], dtype=np.uint8)


def _counted(flags: np.ndarray) -> np.ndarray:
    """Running counts of flags, so that a stretch's count is a difference."""
    out = np.zeros(len(flags) + 1, dtype=np.int32 if len(flags) < 1 << 31 else np.int64)
    np.cumsum(flags.view(np.uint8), out=out[1:], dtype=out.dtype)
    return out


def _hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of stretches of bytes, some million bytes at a time."""
    out, i = np.empty(len(starts), dtype=np.uint64), 0
    size = np.cumsum(ends - starts)
    while i < len(starts):
        done = size[i - 1] if i else 0
        j = max(int(np.searchsorted(size, done + PIECE, side="right")), i + 1)
        lengths = ends[i:j] - starts[i:j]
        first = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        place = np.arange(int(lengths.sum())) - np.repeat(first, lengths)
        codes = mix((place.astype(np.uint64) << np.uint64(8)) + raw[place + np.repeat(starts[i:j], lengths)].astype(np.uint64) + np.uint64(1))
        out[i:j] = mix(np.add.reduceat(codes, first))
        i = j
    return out


def _distinct(owner: np.ndarray, hashes: np.ndarray, n: int) -> np.ndarray:
    """How many different hashes each owner has, by as many of their bits as owners leave in 64 (41 for two million)."""
    bits = np.uint64(max(int(n).bit_length(), 1))
    keys = np.sort((owner.astype(np.uint64) << (np.uint64(64) - bits)) | (hashes >> bits))
    fresh = np.ones(len(keys), dtype=bool)
    fresh[1:] = keys[1:] != keys[:-1]
    return np.bincount((keys[fresh] >> (np.uint64(64) - bits)).astype(np.int64), minlength=n)


def features(texts: list[bytes | None]) -> np.ndarray:
    """A row of FEATURES for each text (UTF-8; null: empty).  Texts are counted some TOGETHER bytes at a time; memory is about forty times those, or the longest text."""
    parts, held, size = [np.empty((0, len(FEATURES)))], [], 0
    for t in texts:
        if held and size + len(t or b"") > TOGETHER:
            parts.append(_features(held))
            held, size = [], 0
        held.append(t)
        size += len(t or b"")
    return np.vstack([*parts, _features(held)] if held else parts)


def _features(texts: list[bytes | None]) -> np.ndarray:
    n = len(texts)
    sizes = np.array([len(t) if t else 0 for t in texts], dtype=np.int64)
    # a line feed after each text keeps words and lines of two texts apart
    raw = np.frombuffer(b"\n".join(t or b"" for t in texts) + b"\n", dtype=np.uint8)
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    code = _CODE[raw]
    run = {name: _counted(code & _BIT[name] != 0) for name in ("upper", "lower", "digit", "symbol", "mark", "wide")}
    per = {name: counts[ends] - counts[starts] for name, counts in run.items()}
    chars = np.maximum(sizes - per["wide"], 1)
    signs = lambda c: np.bincount(np.searchsorted(ends, np.flatnonzero(raw == ord(c))), minlength=n)
    pipes, bangs = signs("|"), signs("!")

    solid = code & _BIT["blank"] == 0
    edge = np.diff(solid.astype(np.int8), prepend=np.int8(0))
    begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    owner = np.searchsorted(ends, begin)
    words = np.bincount(owner, minlength=n)
    safe = np.maximum(words, 1)
    tally = lambda flags: np.bincount(owner[flags], minlength=n)
    upper, lower, odd, wide = (run[name][end] - run[name][begin] for name in ("upper", "lower", "symbol", "wide"))
    length = end - begin - wide
    h = _hashes(raw, begin, end)
    together = owner[1:] == owner[:-1]
    repeat = np.bincount(owner[1:][together & (h[1:] == h[:-1])], minlength=n)
    grams = h.copy()
    whole = np.zeros(len(h), dtype=bool)
    if len(h) > 4:
        for k in range(1, 5):
            grams[:-k] += mix(h[k:] + np.uint64(k))
        whole[:-4] = owner[4:] == owner[:-4]
    n_grams = np.bincount(owner[whole], minlength=n)

    feed = np.flatnonzero(raw == 10)
    line_start, line_end = np.concatenate([[0], feed[:-1] + 1]), feed
    line_words = np.searchsorted(begin, line_end) - np.searchsorted(begin, line_start)
    kept = line_words > 0
    line_start, line_end = line_start[kept], line_end[kept]
    line_owner = np.searchsorted(ends, line_start)
    lines = np.bincount(line_owner, minlength=n)
    line_safe = np.maximum(lines, 1)
    ended = code[np.maximum(line_end - 1, 0)] & _BIT["stop"] != 0

    share = lambda x, y: x / np.maximum(y, 1)
    letters = chars - per["digit"] - per["symbol"] - per["mark"]
    columns = [
        np.log1p(words), share(np.bincount(owner, weights=length, minlength=n), safe), share(tally(length > 20), safe), share(tally(length == 1), safe),
        share(per["upper"], letters), share(tally((upper > 1) & (lower == 0)), safe), share(per["digit"], chars), share(per["symbol"], chars), share(tally(odd > 0), safe), share(pipes, chars), share(per["mark"], chars),
        share(bangs, safe), share(tally((length <= 3) & (odd == 0)), safe), share(_distinct(owner, h, n), safe), share(repeat, safe), 1 - share(_distinct(owner[whole], grams[whole], n), n_grams) * (n_grams > 0) - (n_grams == 0),
        np.log1p(lines), share(words, line_safe), 1 - share(_distinct(line_owner, _hashes(raw, line_start, line_end), n), line_safe) * (lines > 0) - (lines == 0), share(np.bincount(line_owner[ended], minlength=n), line_safe),
    ]
    return np.column_stack(columns).astype(np.float64)


# -- the model ------------------------------------------------------------------------------------


def edges(x: np.ndarray, bins: int = BINS) -> np.ndarray:
    """Inner bounds of a feature's bins: its quantiles, each once."""
    return np.unique(np.quantile(x, np.linspace(0, 1, bins + 1)[1:-1])) if len(x) else np.empty(0)


def binned(x: np.ndarray, bounds: list[np.ndarray]) -> np.ndarray:
    return np.column_stack([np.searchsorted(b, x[:, i], side="right") for i, b in enumerate(bounds)]).astype(np.int64) if len(bounds) else np.empty((len(x), 0), dtype=np.int64)


def _coarse(bins: np.ndarray) -> np.ndarray:
    return bins * COARSE // BINS


def _leaves(grad: np.ndarray, weight: np.ndarray, penalty: float, leaves: int = 4) -> np.ndarray:
    """The values that a tree over ordered bins gives them: cut where the gain is largest, until ``leaves`` parts are there."""
    g, w = np.concatenate([[0], np.cumsum(grad)]), np.concatenate([[0], np.cumsum(weight)])
    score = lambda a, b: (g[b] - g[a]) ** 2 / (w[b] - w[a] + penalty)
    parts = [(0, len(grad))]
    while len(parts) < leaves:
        best = (1e-9, None, None)
        for a, b in parts:
            cut = np.arange(a + 1, b)
            if len(cut):
                gain = score(a, cut) + score(cut, b) - score(a, b)
                i = int(gain.argmax())
                if gain[i] > best[0]:
                    best = (float(gain[i]), (a, b), int(cut[i]))
        if best[1] is None:
            break
        (a, b), c = best[1:]
        parts.remove((a, b))
        parts += [(a, c), (c, b)]
    out = np.empty(len(grad))
    for a, b in parts:
        out[a:b] = (g[b] - g[a]) / (w[b] - w[a] + penalty)
    return out


def _plane(grad: np.ndarray, weight: np.ndarray, penalty: float) -> tuple[np.ndarray, float]:
    """The four values of the best cut of each side of a square of bins, and what it gains over none."""
    g = np.zeros((COARSE + 1, COARSE + 1))
    w = g.copy()
    g[1:, 1:], w[1:, 1:] = grad.cumsum(0).cumsum(1), weight.cumsum(0).cumsum(1)
    value = lambda s, t: s * s / (t + penalty)
    cut = slice(1, COARSE)
    corners = [(g[cut, cut], w[cut, cut]), (g[cut, -1:] - g[cut, cut], w[cut, -1:] - w[cut, cut]), (g[-1:, cut] - g[cut, cut], w[-1:, cut] - w[cut, cut])]
    corners.append((g[-1, -1] - sum(c[0] for c in corners), w[-1, -1] - sum(c[1] for c in corners)))
    gain = sum(value(*c) for c in corners) - value(g[-1, -1], w[-1, -1])
    i, j = np.unravel_index(int(gain.argmax()), gain.shape)
    a, b, c, d = (s[i, j] / (t[i, j] + penalty) for s, t in corners)
    out = np.empty((COARSE, COARSE))
    out[: i + 1, : j + 1], out[: i + 1, j + 1 :], out[i + 1 :, : j + 1], out[i + 1 :, j + 1 :] = a, b, c, d
    return out, float(gain[i, j])


def _chance(margin: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(margin, -30, 30)))


def boost_features(bins: np.ndarray, y: np.ndarray, learns: np.ndarray, base: float, rounds: int, rate: float, penalty: float = 5.0) -> np.ndarray:
    """Tables (feature, bin) from cyclic boosting on the rows that ``learns`` marks, as of the round that suits the others best."""
    tables = np.zeros((bins.shape[1], BINS))
    margin, best, kept, since = np.full(len(y), base), np.inf, tables.copy(), 0
    for _ in range(rounds):
        for f in range(bins.shape[1]):
            p = _chance(margin[learns])
            at = bins[learns, f]
            step = rate * _leaves(np.bincount(at, y[learns] - p, BINS), np.bincount(at, p * (1 - p), BINS), penalty)
            tables[f] += step
            margin += step[bins[:, f]]
        loss, since = _loss(margin, y, ~learns), since + 1
        if loss < best - 1e-5:
            best, kept, since = loss, tables.copy(), 0
        elif since >= 20:
            break
    return kept


def _loss(margin: np.ndarray, y: np.ndarray, rows: np.ndarray) -> float:
    return float(np.mean(np.logaddexp(0, np.where(y[rows] > 0, -margin[rows], margin[rows])))) if rows.any() else 0.0


def strengths(bins: np.ndarray, y: np.ndarray, margin: np.ndarray, penalty: float = 5.0) -> dict[tuple[int, int], float]:
    """What the best cut of each pair of features gains on what ``margin`` leaves."""
    p, c = _chance(margin), _coarse(bins)
    g, w, out = y - p, p * (1 - p), {}
    for i in range(bins.shape[1]):
        for j in range(i):
            at = c[:, j] * COARSE + c[:, i]
            out[j, i] = _plane(np.bincount(at, g, COARSE**2).reshape(COARSE, COARSE), np.bincount(at, w, COARSE**2).reshape(COARSE, COARSE), penalty)[1]
    return out


def boost_pairs(bins: np.ndarray, y: np.ndarray, learns: np.ndarray, margin: np.ndarray, pairs: list[tuple[int, int]], rounds: int, rate: float, penalty: float = 5.0) -> np.ndarray:
    """Tables (pair, bin, bin) by cyclic boosting on top of ``margin``."""
    tables = np.zeros((len(pairs), COARSE, COARSE))
    c = _coarse(bins)
    at = [c[:, i] * COARSE + c[:, j] for i, j in pairs]
    margin, best, kept, since = margin.copy(), _loss(margin, y, ~learns), tables.copy(), 0
    for _ in range(rounds):
        for k, cell in enumerate(at):
            p = _chance(margin[learns])
            g, w = np.bincount(cell[learns], y[learns] - p, COARSE**2), np.bincount(cell[learns], p * (1 - p), COARSE**2)
            step = rate * _plane(g.reshape(COARSE, COARSE), w.reshape(COARSE, COARSE), penalty)[0]
            tables[k] += step
            margin += step.ravel()[cell]
        loss, since = _loss(margin, y, ~learns), since + 1
        if loss < best - 1e-5:
            best, kept, since = loss, tables.copy(), 0
        elif since >= 10:
            break
    return kept


def margins(x: np.ndarray, model: dict) -> np.ndarray:
    """Sums of the table entries that the rows' bins name."""
    bins = binned(x, model["bounds"])
    out = np.full(len(x), model["base"]) + model["tables"][np.arange(bins.shape[1]), bins].sum(axis=1)
    c = _coarse(bins)
    for (i, j), table in zip(model["pairs"], model["planes"], strict=True):
        out += table[c[:, i], c[:, j]]
    return out


# -- Spark ----------------------------------------------------------------------------------------


def _laid_out(frame: pd.DataFrame, bounds: list[np.ndarray], bag: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bins, labels and which rows the bag learns from, in an order of their own, so that reruns add in the same order."""
    x = np.array(frame["x"].tolist(), dtype=np.float64).reshape(len(frame), len(FEATURES))
    y, learns = frame["label"].to_numpy(), (frame["out"] != bag).to_numpy()
    order = np.lexsort((*x.T, y, learns))
    return binned(x[order], bounds), y[order], learns[order]


def _featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = features(batch.column(0).cast(pa.binary()).to_pylist())
        yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(list(x), pa.list_(pa.float64()))], names=[*batch.schema.names[1:], "x"])


def _score(model: dict):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = _chance(margins(features(batch.column(0).cast(pa.binary()).to_pylist()), model))
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array(p)], names=["doc_id", "held_out", "score"])

    return run


def fit(labelled: DataFrame, bags: int = 8, n_pairs: int = 10, rounds: int = 150, rate: float = 0.1) -> dict | None:
    """The model (base, bounds, tables, pairs, planes) from (doc_id, text, label); None without rows, no tables with one class.

    Each bag leaves out the rows whose hash falls to it, stops by them and is boosted in a task of its own; bags hold
    the whole of ``labelled``, so its size must be bounded.  The driver gets the bags' tables: 20 x 64 and 10 x 256 numbers each.
    """
    rows = materialise(labelled.select("text", F.col("label").cast("double").alias("label"), F.pmod(F.xxhash64("doc_id", F.lit("bag")), F.lit(bags)).cast("int").alias("out")).mapInArrow(_featurise, "label double, out int, x array<double>"), "features")
    seen = rows.agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("good")).first()
    if not seen["n"]:
        return None
    base = float(np.log((seen["good"] + 0.5) / (seen["n"] - seen["good"] + 0.5)))
    none = np.zeros((len(FEATURES), BINS))
    if seen["good"] in (0, seen["n"]):
        return {"base": base, "bounds": [np.empty(0)] * len(FEATURES), "tables": none, "pairs": [], "planes": []}
    parts = np.linspace(0, 1, BINS + 1)[1:-1].tolist()
    cuts = rows.agg(*(F.percentile(F.col("x")[i], F.array(*map(F.lit, parts))).alias(f) for i, f in enumerate(FEATURES))).first()
    bounds = [np.unique(np.array(cuts[f], dtype=np.float64)) for f in FEATURES]
    dealt = rows.withColumn("bag", F.explode(F.sequence(F.lit(0), F.lit(bags - 1)))).repartition(2 * bags, "bag")

    def first(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        bins, y, learns = _laid_out(frame, bounds, key[0])
        tables = boost_features(bins, y, learns, base, rounds, rate)
        margin = base + tables[np.arange(len(FEATURES)), bins].sum(axis=1)
        gains = strengths(bins, y, margin)
        return pd.DataFrame({"bag": [key[0]], "tables": [tables.ravel().tolist()], "pairs": [[a * len(FEATURES) + b for a, b in gains]], "gains": [list(gains.values())]})

    mains = dealt.groupBy("bag").applyInPandas(first, "bag int, tables array<double>, pairs array<int>, gains array<double>").collect()
    gained: dict[int, float] = {}
    for r in mains:
        for pair, gain in zip(r["pairs"], r["gains"], strict=True):
            gained[pair] = gained.get(pair, 0.0) + gain
    pairs = [divmod(p, len(FEATURES)) for p in sorted(gained, key=lambda p: (-gained[p], p))[:n_pairs]]
    tables = np.mean([np.array(r["tables"]) for r in sorted(mains, key=lambda r: r["bag"])], axis=0).reshape(len(FEATURES), BINS)

    def second(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        bins, y, learns = _laid_out(frame, bounds, key[0])
        planes = boost_pairs(bins, y, learns, base + tables[np.arange(len(FEATURES)), bins].sum(axis=1), pairs, rounds, rate)
        return pd.DataFrame({"bag": [key[0]], "planes": [planes.ravel().tolist()]})

    each = dealt.groupBy("bag").applyInPandas(second, "bag int, planes array<double>").collect()
    planes = np.mean([np.array(r["planes"]) for r in sorted(each, key=lambda r: r["bag"])], axis=0).reshape(len(pairs), COARSE, COARSE)
    return {"base": base, "bounds": bounds, "tables": tables, "pairs": pairs, "planes": list(planes)}


def score(docs: DataFrame, labels: DataFrame, held_out, sample: int = 12_000, least: float = 0.3, **options) -> DataFrame:
    """doc_id, held_out, score (0 to 1, higher: of better quality), predicted (1 if score >= ``least``) for every row.

    Learns from at most ``sample`` labelled documents (a stated bound; those of least hash of doc_id) for which ``held_out`` (a Column
    over doc_id) is false.  Null labels teach nothing; a doc_id labelled twice is good only if no label says otherwise.  With one
    class to learn from every score is near that class; with nothing to learn from it is 0.5.  Null and empty texts are scored as texts
    without words; repeated rows are scored each; extra columns do not matter.
    """
    bounded_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("held_out", F.coalesce(held_out, F.lit(False)))
    known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").cast("int").alias("label"))
    known = known.where(~F.coalesce(held_out, F.lit(False))).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    # one row a doc_id, so that repeats of a document do not raise the bound
    labelled = docs.join(F.broadcast(known), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.min("label").alias("label"))
    model = fit(labelled, **options)
    if model is None:
        return docs.select("doc_id", "held_out", F.lit(0.5).alias("score"), F.lit(int(least <= 0.5)).alias("predicted"))
    scored = docs.select("text", "doc_id", "held_out").mapInArrow(_score(model), "doc_id long, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= least).cast("int"))
