"""Toxicity: gradient-boosted trees over dense text features, isotonically calibrated.

Fitting reads a bounded sample of the labelled rows (``sample_rows`` of each class,
taken by a hash of the id, so the same rows every time): their ids are few enough to
broadcast, and documents are filtered by them without a shuffle.

1. Lexicon: words and word stems much likelier in toxic texts of the fitting
   folds. A term must occur in a fixed share of the toxic texts, so there are at most
   (distinct words a text) / share of them, whatever the corpus.
2. Features of a text: lexicon densities and weights, nearness of a second-person word to
   lexicon words, capitals, punctuation, symbols, obfuscated words.
3. Spark ML gradient-boosted trees on the fitting folds, isotonic regression on
   another fold that neither lexicon nor trees have seen, weighted back to the
   labels' own shares.

Scoring is a pandas UDF for the features and the Spark ML models after it: no
shuffle, no join, and every column of the documents stays where it is.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from .common import cut, picked

WORD = re.compile(r"[^\W\d_]+")
# starts at a word's first letter and never goes back: linear in any text
DISGUISED = re.compile(r"(?<![^\W\d_])[^\W\d_]++(?:[0-9@$*!#%&.]++[^\W\d_]++)++")
SPACED = re.compile(r"\b[^\W\d_](?:[ .*_-][^\W\d_]\b){3,}")
LEET = str.maketrans("013457@$!", "oieastasi")
STEM, STEM_OF = 5, 7  # letters of a stem, least letters of a word that has one
NEAR = 5  # words

# Second-person words of the languages served (fixed list, natural order).
YOU = frozenset(
    "you your yours yourself yourselves u ur du dich dir dein deine deinen deinem deiner ihr euch euer eure "
    "tu te toi ton ta tes vous votre vos tú ti tus usted ustedes vosotros vosotras os vuestro".split())

FEATURES = [
    "word_density", "word_hits", "word_weight", "word_weights", "stem_density", "stem_hits", "stem_weight",
    "you_nearness", "you_share", "capitals", "shouted", "exclaimed", "symbols", "disguised", "disguised_hits", "words",
]
FOLDS = 5  # crc32(id as text) mod 5: fold 0 is held out, 1-3 fit, 4 calibrates
CALIBRATE = 4
RANK = 1e-3  # share of the uncalibrated score that keeps the order inside a calibrated step

_BYTE = np.zeros(256, np.int8)  # 1 lower-case, 2 upper-case, 3 ! and ?, 4 other symbols
_BYTE[97:123], _BYTE[65:91] = 1, 2
_BYTE[[33, 63]] = 3
_BYTE[[ord(c) for c in "#$%&*+/<=>@\\^_`{|}~"]] = 4


def fold(id_col: Column) -> Column:
    """Fold of a document: crc32 of its id as text, modulo 5 (null id: of the empty text)."""
    return F.pmod(F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")), F.lit(FOLDS))


def stem(word: str) -> str | None:
    return word[:STEM] if len(word) >= STEM_OF else None


def terms(text: str | None) -> set[str]:
    """Distinct lexicon terms of a text: words, and stems marked with a trailing dash."""
    found = set(WORD.findall((text or "").lower()))
    return found | {w[:STEM] + "-" for w in found if len(w) >= STEM_OF}


def undisguised(text: str) -> list[str]:
    """Words written with digits or symbols between their letters, or letter by letter, set right."""
    inner = [re.sub(r"[^\w]|\d|_", "", m.translate(LEET)) for m in DISGUISED.findall(text)]
    bare = [re.sub(r"[^\w]|\d|_", "", m) for m in DISGUISED.findall(text)]
    return inner + bare + [re.sub(r"[ .*_-]", "", m) for m in SPACED.findall(text)]


def text_features(text: str | None, lexicon: dict[str, float]) -> list[float]:
    """The FEATURES of one text; all zero for a null or empty one."""
    text = text or ""
    low = text.lower()
    words = WORD.findall(low)
    n = len(words)
    kinds = np.bincount(_BYTE[np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)], minlength=5)
    letters = max(1, int(kinds[1] + kinds[2]))
    size = max(1, len(text))
    known = set(words)
    bad = known & lexicon.keys()
    bad_stems = {w for w in known if len(w) >= STEM_OF and w[:STEM] + "-" in lexicon}
    hits = stem_hits = 0
    nearness = share = weights = 0.0
    if bad or bad_stems:
        count = Counter(words)
        hits, stem_hits = sum(count[w] for w in bad), sum(count[w] for w in bad_stems)
        weights = sum(lexicon[w] * count[w] for w in bad)
        you = np.array([i for i, w in enumerate(words) if w in YOU])
        if len(you):
            at = np.array([i for i, w in enumerate(words) if w in bad or w in bad_stems])
            right = np.searchsorted(you, at)
            gap = np.minimum(
                np.abs(you[np.minimum(right, len(you) - 1)] - at), np.abs(at - you[np.maximum(right - 1, 0)]))
            nearness, share = float((1 / (1 + gap)).max()), float((gap <= NEAR).mean())
    odd = DISGUISED.findall(low) + SPACED.findall(low)
    odd_hits = sum(w in lexicon for w in undisguised(low)) if odd else 0
    shouted = 0.0
    if kinds[2] > 1:
        shouted = sum(len(w) > 1 and w.isupper() for w in WORD.findall(text)) / max(1, n)
    return [
        hits / max(1, n), math.log1p(hits), max([lexicon[w] for w in bad], default=0.0), weights / max(1.0, math.sqrt(n)),
        stem_hits / max(1, n), math.log1p(stem_hits), max([lexicon[w[:STEM] + "-"] for w in bad_stems], default=0.0),
        nearness, share, float(kinds[2]) / letters, shouted, float(kinds[3]) / size, float(kinds[4]) / size,
        len(odd) / max(1, n), math.log1p(odd_hits), math.log1p(n),
    ]


def sample_labels(labels: DataFrame, id_col: str, label_col: str, sample_rows: int) -> DataFrame:
    """At most ``sample_rows`` labelled ids of each class outside the held-out fold.

    ``id, y, fold, weight``: a class's rows that are not taken weigh on those that are.
    Labels other than 0 and 1 and rows without id are ignored; of several
    labels of an id the largest counts.
    """
    one = (
        picked(labels, id=id_col, y=label_col).where("id IS NOT NULL AND y IN (0, 1)")
        .groupBy("id").agg(F.max(F.col("y").cast("double")).alias("y")).withColumn("fold", fold(F.col("id"))).where("fold <> 0")
    )
    total = {r["y"]: r["n"] for r in one.groupBy("y").agg(F.count("*").alias("n")).collect()}  # two rows
    taken = [
        one.where(F.col("y") == y).orderBy(F.xxhash64("id", F.lit(7)), "id").limit(sample_rows)
        .withColumn("weight", F.lit(total.get(y, 0) / max(1, min(total.get(y, 0), sample_rows))))
        for y in (0.0, 1.0)
    ]
    return taken[0].unionByName(taken[1])


def learn_lexicon(rows: DataFrame, share: float, least: int, odds: float) -> dict[str, float]:
    """Terms with log-odds >= ``odds`` for toxic texts, in ``share`` of them and ``least`` at least.

    ``rows`` has ``text`` and ``y``. Counted in Spark; the result is bounded by
    (distinct terms a text) / share.
    """

    def count(it):
        for pdf in it:
            bad, good = Counter(), Counter()
            for text, y in zip(pdf["text"], pdf["y"]):
                (bad if y else good).update(terms(text))
            keys = list(bad.keys() | good.keys())
            yield pd.DataFrame({
                "term": pd.Series(keys, dtype=object), "bad": [bad[k] for k in keys], "good": [good[k] for k in keys]})

    total = rows.agg(F.sum("y").alias("bad"), F.sum(1 - F.col("y")).alias("good")).first()
    if not total["bad"] or not total["good"]:
        return {}
    n_bad, n_good = total["bad"], total["good"]
    log_odds = (
        F.log((F.col("bad") + 0.5) / (n_bad - F.col("bad") + 0.5)) - F.log((F.col("good") + 0.5) / (n_good - F.col("good") + 0.5)))
    counted = rows.select("text", "y").mapInPandas(count, "term string, bad bigint, good bigint")
    kept = counted.groupBy("term").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good")).where(
        F.col("bad") >= max(least, share * n_bad)).withColumn("odds", log_odds).where(F.col("odds") >= odds)
    return {r["term"]: r["odds"] for r in kept.select("term", "odds").collect()}


class ToxicityModel:
    """A fitted lexicon, trees and calibration; ``scored`` adds the score to any documents."""

    def __init__(self, spark, lexicon: dict[str, float], trees, calibration, prior: float):
        self.lexicon = spark.sparkContext.broadcast(lexicon)
        self.trees, self.calibration, self.prior = trees, calibration, prior

    def features(self, text: Column) -> Column:
        return _features_of(self.lexicon)(text)

    def scored(self, docs: DataFrame, text_col: str = "text", score_col: str = "score") -> DataFrame:
        """``docs`` with a double ``score_col`` in 0 to 1; null and empty texts are scored too."""
        if self.trees is None:
            return docs.withColumn(score_col, F.lit(float(self.prior)))
        out = self.trees.transform(docs.withColumn("_echoset_features", array_to_vector(self.features(F.col(f"`{text_col}`")))))
        out = out.withColumn("_echoset_raw_score", vector_to_array("_echoset_probability")[1])
        score = F.col("_echoset_raw_score")
        if self.calibration is not None:
            out = self.calibration.transform(out)
            score = (1 - RANK) * F.col("_echoset_calibrated") + RANK * score
        out = out.withColumn(score_col, F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)))
        return out.drop("_echoset_features", "_echoset_raw", "_echoset_probability", "_echoset_prediction", "_echoset_raw_score", "_echoset_calibrated")


def _features_of(lexicon):
    def features(texts: pd.Series) -> pd.Series:
        return pd.Series([text_features(t, lexicon.value) for t in texts], dtype=object)

    return F.pandas_udf(features, ArrayType(DoubleType()))


def fit_toxicity(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
    sample_rows: int = 20_000, share: float = 0.002, least: int = 3, odds: float = 2.0, trees: int = 30, depth: int = 4,
    seed: int = 42,
) -> ToxicityModel:
    """Fit on a bounded sample of the labelled rows (``sample_rows`` of each class).

    Without labelled rows of both classes in the fitting folds every text
    scores the toxic share of the labels (0 without labels).
    """
    spark = docs.sparkSession
    ids = cut(sample_labels(labels, id_col, label_col, sample_rows))
    rows = cut(picked(docs, id=id_col, text=text_col).join(F.broadcast(ids), "id").dropDuplicates(["id"]).select("text", "y", "fold", "weight"))
    fit, held = rows.where(F.col("fold") != CALIBRATE), rows.where(F.col("fold") == CALIBRATE)
    lexicon = learn_lexicon(fit, share, least, odds)
    prior = ids.agg(F.sum(F.col("y") * F.col("weight")) / F.sum("weight")).first()[0] or 0.0
    if fit.select("y").distinct().count() < 2:
        return ToxicityModel(spark, lexicon, None, None, prior)
    of = _features_of(spark.sparkContext.broadcast(lexicon))
    table = cut(rows.select(array_to_vector(of("text")).alias("_echoset_features"), "y", "fold", "weight").repartition(
        spark.sparkContext.defaultParallelism))
    boosted = GBTClassifier(
        featuresCol="_echoset_features", labelCol="y", predictionCol="_echoset_prediction", maxIter=trees, maxDepth=depth,
        stepSize=0.2, seed=seed,
    ).setRawPredictionCol("_echoset_raw").setProbabilityCol("_echoset_probability")
    model = boosted.fit(table.where(F.col("fold") != CALIBRATE))
    raw = model.transform(table.where(F.col("fold") == CALIBRATE)).select(
        vector_to_array("_echoset_probability")[1].alias("_echoset_raw_score"), "y", "weight")
    calibration = None
    if held.select("y").distinct().count() == 2:
        calibration = IsotonicRegression(
            featuresCol="_echoset_raw_score", labelCol="y", weightCol="weight", predictionCol="_echoset_calibrated").fit(raw)
    return ToxicityModel(spark, lexicon, model, calibration, prior)


def toxicity_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **kw) -> DataFrame:
    """``<id_col>``, ``held_out``, ``score``, ``predicted``; one row per row of ``docs``.

    ``held_out`` rows (crc32 of the id as text mod 5 is 0) were never used in
    fitting. Only the text enters a score. An empty table gives an empty result.
    """
    model = fit_toxicity(docs, labels, id_col, text_col, **kw)
    src = picked(docs, id=id_col, text=text_col)
    return model.scored(src).select(
        F.col("id").alias(id_col), (fold(F.col("id")) == 0).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **kw) -> DataFrame:
    """The rows of ``docs`` scored below 0.5, with all their columns."""
    model = fit_toxicity(docs, labels, id_col, text_col, **kw)
    return model.scored(docs, text_col, "_echoset_score").where("_echoset_score < 0.5").drop("_echoset_score")
