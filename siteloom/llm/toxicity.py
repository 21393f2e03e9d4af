"""Toxicity by gradient-boosted trees over dense features, with isotonic calibration.

A lexicon is counted from labelled documents (words far commoner in toxic ones).  Features are
densities of its words, plain and after undoing obfuscation, how near they stand to the second
person, and rates of capitals, punctuation and obfuscated words.  The trees and the isotonic
regression are Spark's own, fitted on a stated sample of labelled rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siteloom.llm.common import BLANK, bounded_batches, materialise

#: Words of the second person in the languages at hand (fixed values).
SECOND_PERSON = "you your yours yourself u ur du dich dir dein deine ihr euch tu te toi ton ta tes vous votre vos tú ti tuyo usted ustedes vosotros".split()
NEAR = 5
#: Signs that may stand around a word.
_AROUND = "!\"#%&'()*+,-./:;<=>?[\\]^`{|}~«»„“”‘’…¿¡–—"
_LEET = str.maketrans("013457@$!", "oieastasi")
_INNER = re.compile(r"[^\W\d_][\d@$*!.\-_]+[^\W\d_]")
_DOUBLED = re.compile(r"(.)\1{2,}")
FEATURES = [
    "lexicon_density", "lexicon_log", "lexicon_best", "lexicon_mean", "weak_density", "hidden_density", "hidden_log", "near_second", "second_density",
    "capitals", "shouted", "exclaimed", "asked", "punctuated", "obfuscated", "drawn_out", "log_words",
]


def _undo(word: str) -> str:
    """What an obfuscated word may stand for: look-alike digits and signs, inner signs, drawn-out letters."""
    return _DOUBLED.sub(r"\1", re.sub(r"[^\w]|_", "", word.translate(_LEET)))


def features(text: str | None, lexicon: dict[str, float], second: frozenset[str] = frozenset(SECOND_PERSON)) -> list[float]:
    text = text or ""
    raw = text.split()
    n = max(len(raw), 1)
    words = [w.strip(_AROUND) for w in text.lower().split()]
    known = [(i, lexicon[w]) for i, w in enumerate(words) if w in lexicon]
    hits, weights = [i for i, x in known if x >= 2], [x for _, x in known if x >= 2]
    weak = len(known) - len(hits)
    person = [i for i, w in enumerate(words) if w in second]
    hidden = odd = drawn = shouted = 0
    for i, w in [(i, w) for i, w in enumerate(words) if w and not w.isalpha()]:
        if w not in lexicon:
            odd += _INNER.search(w) is not None
            if lexicon.get(_undo(w), 0) >= 2:
                hidden += 1
                hits.append(i)
    if _DOUBLED.search(text):
        for w in words:
            if w.isalpha() and _DOUBLED.search(w):
                drawn += 1
                hidden += lexicon.get(_DOUBLED.sub(r"\1", w), 0) >= 2
    at = np.array(person)
    near = sum(bool((np.abs(at - h) <= NEAR).any()) for h in hits) if person else 0
    upper = sum(map(str.isupper, text)) if not text.islower() else 0
    if upper:
        shouted = sum(w.isupper() and len(w) > 1 for w in raw)
    marks = text.count("!"), text.count("?"), sum(map(text.count, ".,;:-"))
    return [
        100.0 * len(hits) / n, np.log1p(len(hits)), max(weights, default=0.0), float(np.mean(weights)) if weights else 0.0, 100.0 * weak / n, 100.0 * hidden / n, np.log1p(hidden),
        near / max(len(hits), 1), 100.0 * len(person) / n, upper / max(len(text), 1), shouted / n, 100.0 * marks[0] / n, 100.0 * marks[1] / n, marks[2] / n, 100.0 * odd / n, 100.0 * drawn / n, np.log1p(len(raw)),
    ]


def _featurise(lexicon: dict[str, float]):
    names = ["doc_id", "held_out", *FEATURES]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [features(t, lexicon) for t in batch.column(2).to_pylist()]
            x = np.array(rows, dtype=np.float64).reshape(len(rows), len(FEATURES))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(x[:, i]) for i in range(len(FEATURES)))], names=names)

    return run


_SCHEMA = "doc_id long, held_out boolean, " + ", ".join(f"{f} double" for f in FEATURES)


def learn_lexicon(labelled: DataFrame, size: int = 5000, least: int = 3) -> dict[str, float]:
    """Words in at least ``least`` toxic documents with their log odds ratio, the ``size`` largest: a size of the model, like its number of trees."""
    word = F.regexp_replace(F.lower("word"), r"^[^\p{L}\p{N}_@$]+|[^\p{L}\p{N}_@$]+$", "")
    words = labelled.select("toxic", F.explode(F.array_distinct(F.split("text", BLANK))).alias("word")).select("toxic", word.alias("word"))
    counts = words.where("word <> ''").groupBy("word").agg(F.sum("toxic").alias("bad"), F.count(F.lit(1)).alias("n"))
    total = labelled.agg(F.sum("toxic").alias("b"), F.count(F.lit(1)).alias("a")).first()
    bad, good = float(total["b"] or 0), float((total["a"] or 0) - (total["b"] or 0))
    odds = F.log((F.col("bad") + 0.5) / (bad + 1)) - F.log((F.col("n") - F.col("bad") + 0.5) / (good + 1))
    top = counts.where(F.col("bad") >= least).withColumn("odds", odds).where("odds > 0.7").orderBy(F.desc("odds"), "word").limit(size)
    return {r["word"]: r["odds"] for r in top.collect()}


def score(docs: DataFrame, labels: DataFrame, held_out, sample: int = 12_000, trees: int = 20, depth: int = 4) -> DataFrame:
    """doc_id, held_out, score (0 to 1), predicted (1 if score >= 0.5) for every row.

    Learns from at most ``sample`` labelled documents (a stated bound; those of least hash of
    doc_id) for which ``held_out`` (a Column over doc_id) is false: the lexicon and the trees from four
    fifths, the calibration from the rest.  Null labels teach nothing; a doc_id labelled twice is toxic if one label says so.  With only
    one class to learn from every score is that class's share.  Null and empty texts are scored like any other.
    """
    bounded_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("held_out", F.coalesce(held_out, F.lit(False)))
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    known = known.where(~F.coalesce(held_out, F.lit(False))).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    labelled = materialise(docs.join(F.broadcast(known), "doc_id").withColumn("calibrates", F.xxhash64("doc_id", F.lit("calibration")) % 5 == 0), "labelled")
    seen = labelled.agg(F.count(F.lit(1)).alias("n"), F.sum("toxic").alias("bad")).first()
    n, bad = seen["n"] or 0, seen["bad"] or 0
    if bad in (0, n):
        share = bad / n if n else 0.0
        return docs.select("doc_id", "held_out", F.lit(float(share)).alias("score"), F.lit(int(share >= 0.5)).alias("predicted"))
    lexicon = learn_lexicon(labelled.where(~F.col("calibrates")))
    pack = VectorAssembler(inputCols=FEATURES, outputCol="x")
    training = labelled.select("doc_id", "held_out", "text").mapInArrow(_featurise(lexicon), _SCHEMA)
    training = training.join(F.broadcast(labelled.select("doc_id", "toxic", "calibrates").distinct()), "doc_id")
    training = materialise(pack.transform(training).select("x", F.col("toxic").cast("double").alias("label"), "calibrates").coalesce(4), "features")
    model = GBTClassifier(featuresCol="x", maxIter=trees, maxDepth=depth, stepSize=0.2, seed=7).fit(training.where(~F.col("calibrates")))

    def margin(df: DataFrame) -> DataFrame:
        out = model.transform(df)
        return out.withColumns({"margin": vector_to_array("rawPrediction")[1], "chance": vector_to_array("probability")[1]})

    held = margin(training.where("calibrates"))
    isotonic = IsotonicRegression(featuresCol="margin", labelCol="label", predictionCol="level").fit(held.select("margin", "label"))
    every = pack.transform(docs.select("doc_id", "held_out", "text").mapInArrow(_featurise(lexicon), _SCHEMA))
    levels = isotonic.transform(margin(every).select("doc_id", "held_out", "margin", "chance"))
    # within one level of the calibration the trees' own probability decides the order
    value = F.least(F.greatest(0.99 * F.col("level") + 0.01 * F.col("chance"), F.lit(0.0)), F.lit(1.0))
    return levels.select("doc_id", "held_out", value.alias("score")).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
