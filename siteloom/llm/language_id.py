"""Language identification by nearest centroids of TF-IDF vectors of character n-grams.

Vectors are normalised counts of hashed byte n-grams of the lower-cased letters of a text, with
inverse document frequencies.  A language has several centroids (spherical k-means), since it
may be written in unlike ways.  A text belongs to the language of the centroid with the largest
cosine; one that is far from all of them is marked rejected, and still told its nearest language.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siteloom.llm.common import bounded_batches

#: Hashed n-gram features.
DIM = 4096
UNDETERMINED = "und"


def _squeeze(text: str) -> bytes:
    """Words of letters with a space around each."""
    return b" " + " ".join("".join(c if c.isalpha() else " " for c in text.lower()).split()).encode("utf-8", "replace") + b" "


_ASCII = bytes(b if 97 <= b <= 122 or b >= 128 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def letters(text: str | None) -> bytes:
    if not text:
        return b""
    if text.isascii():
        out = b" " + b" ".join(text.encode().translate(_ASCII).split()) + b" "
    else:
        out = _squeeze(text)
    return out if len(out) > 2 else b""


def grams(raw: bytes) -> np.ndarray:
    """Counts of hashed 1-, 2- and 3-grams of bytes; unigrams and blanks alone carry little."""
    b = np.frombuffer(raw, dtype=np.uint8).astype(np.uint32)
    two = b[:-1] * np.uint32(0x9E3779B1) ^ b[1:] * np.uint32(0x85EBCA77)
    three = two[:-1] ^ b[2:] * np.uint32(0xC2B2AE3D)
    h = np.concatenate([two ^ np.uint32(0x27D4EB2F), three])
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    return np.bincount(h >> np.uint32(20), minlength=DIM).astype(np.float32)


def _unit(x: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(x, axis=-1, keepdims=True)
    return x / np.where(norm > 0, norm, 1)


def _damp(counts: np.ndarray) -> np.ndarray:
    return np.sqrt(counts)


def _learn_one(clusters: int, rounds: int):
    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["order", "doc_id", "text"])
        x = _unit(_damp(np.stack([grams(r) for t in pdf["text"] if (r := letters(t))] or [np.zeros(DIM, dtype=np.float32)])) * np.frombuffer(pdf["idf"].iloc[0], dtype=np.float32))
        # spread-out first centres, then spherical k-means
        centres = [_unit(x.mean(axis=0))]
        while len(centres) < min(clusters, len(x)):
            centres.append(x[np.argmin((x @ np.stack(centres).T).max(axis=1))])
        c = np.stack(centres)
        for _ in range(rounds):
            near = np.argmax(x @ c.T, axis=1)
            c = np.stack([_unit(x[near == k].mean(axis=0)) if (near == k).any() else c[k] for k in range(len(c))])
        near = x @ c.T
        least = np.quantile(near.max(axis=1), 0.005)
        return pd.DataFrame({"lang": pdf["lang"].iloc[0], "centroid": [v.astype(np.float32).tobytes() for v in c], "least": float(least)})

    return fit


def _frequencies(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    n, df = 0, np.zeros(DIM, dtype=np.int64)
    for pdf in batches:
        for t in pdf["text"]:
            if r := letters(t):
                n += 1
                df += grams(r) > 0
    yield pd.DataFrame({"slot": np.arange(DIM + 1, dtype=np.int32), "n": np.append(df, n)})


def sampled(known: DataFrame, sample: int) -> DataFrame:
    """At most ``sample`` rows (lang, doc_id, text, order) a language, those of least row hash; rows of one doc_id and text count once.

    A hash threshold for each language lets little more than the sample through before any row is shuffled."""
    keyed = known.withColumn("order", F.xxhash64("doc_id", "text"))
    sizes = keyed.groupBy("lang").agg(F.approx_count_distinct("order", 0.02).alias("n"))
    # six standard deviations and the error of the count above what is wanted
    most = 1.15 * (sample + 6 * sample**0.5 + 20)
    # a row a language, like the model
    place = F.shiftrightunsigned("order", 11) / float(1 << 53)
    few = keyed.join(F.broadcast(sizes), "lang").where(place * F.col("n") <= most)
    once = few.groupBy("lang", "doc_id", "order").agg(F.first("text").alias("text"))
    least = Window.partitionBy("lang").orderBy(F.shiftrightunsigned("order", 11), "order", "doc_id")
    return once.withColumn("r", F.row_number().over(least)).where(F.col("r") <= sample).drop("r")


def frequencies(known: DataFrame) -> np.ndarray:
    """Documents of ``known`` that hold each feature, over all rows; the last number is that of all documents with letters."""
    slots = known.select("text").mapInPandas(_frequencies, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).toPandas()
    df = np.zeros(DIM + 1)
    df[slots["slot"].to_numpy()] = slots["n"]
    return df


def learn(docs: DataFrame, clusters: int = 4, rounds: int = 8, sample: int = 2000) -> list[tuple[str, np.ndarray, float]]:
    """Centroids of each language from at most ``sample`` documents of it (a stated bound; those of
    least row hash), and the cosine under which a text is rejected; document frequencies are those
    of all rows.  Rows without lang or text teach nothing.

    The driver holds the centroids: languages times clusters vectors of DIM numbers.
    """
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text", "lang")
    df = frequencies(known)
    rows = sampled(known, sample)
    idf = np.log((1 + df[DIM]) / (1 + df[:DIM])).astype(np.float32) + np.float32(0.1)
    learned = rows.withColumn("idf", F.lit(idf.tobytes())).groupBy("lang").applyInPandas(_learn_one(clusters, rounds), "lang string, centroid binary, least double")
    found = sorted(map(tuple, learned.collect()))
    # the weights go into the centroids: cosine of weighted vectors needs them for the text's norm only
    return [(lang, np.stack([np.frombuffer(c, dtype=np.float32), idf]), least) for lang, c, least in found]


def _predict(model: list[tuple[str, np.ndarray, float]]):
    langs = sorted({m[0] for m in model})
    if model:
        idf = model[0][1][1]
        centroids = np.stack([m[1][0] for m in model]).T
        owner = np.array([langs.index(m[0]) for m in model])
        least = np.array([next(m[2] for m in model if m[0] == lang) for lang in langs])
        groups = [np.flatnonzero(owner == k) for k in range(len(langs))]

    def block(raws: list[bytes]) -> tuple[list, list, list]:
        x = _unit(_damp(np.stack([grams(r) if r else np.zeros(DIM, dtype=np.float32) for r in raws])) * idf)
        per = np.stack([(x @ centroids)[:, g].max(axis=1) for g in groups], axis=1)
        best = per.argmax(axis=1)
        score = np.clip(per[np.arange(len(best)), best], 0, 1)
        none = np.array([not r for r in raws])
        return (
            [UNDETERMINED if n else langs[b] for b, n in zip(best.tolist(), none.tolist(), strict=True)],
            np.where(none, 0.0, score).astype(float).tolist(),
            (none | (score < least[best])).tolist(),
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang, score, rejected = [], [], []
            for part in itertools.batched((letters(t) for t in batch.column(2).to_pylist()), 256):
                a, b, c = block(list(part)) if model else ([UNDETERMINED] * len(part), [0.0] * len(part), [True] * len(part))
                lang += a
                score += b
                rejected += c
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())],
                names=["doc_id", "held_out", "lang_pred", "score", "rejected"],
            )

    return run


def predict(docs: DataFrame, held_out, **options) -> DataFrame:
    """doc_id, held_out, lang_pred, score (cosine, 0 to 1), rejected for every row.

    Learns from rows where ``held_out`` (a Column) is false; texts that are null or hold no
    letter are ``und`` with score 0.  With nothing to learn from all are ``und``.  lang, source
    and doc_id are no inputs of a prediction; repeated rows get the same.
    """
    bounded_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang").withColumn("held_out", F.coalesce(held_out, F.lit(False)))
    model = learn(docs.where(~F.col("held_out")), **options)
    out = "doc_id long, held_out boolean, lang_pred string, score double, rejected boolean"
    return docs.select("doc_id", "held_out", "text").mapInArrow(_predict(model), out)
