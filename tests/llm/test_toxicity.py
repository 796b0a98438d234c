import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from echoset.llm.toxicity import FEATURES, drop_toxic, fit_toxicity, learn_lexicon, terms, text_features, toxicity_scores, undisguised

from .fixtures import CLASHING, awkward_rows, docs_frame, prose

FEW = {"trees": 4, "depth": 3}  # enough for these texts, and quick to fit
INSULTS = ["wretch", "dullard", "knavebert", "knaveling", "oafish"]


def labelled(n=700, seed=3):
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        words = prose(rng, rng.randint(5, 80)).split()
        toxic = i % 4 == 0
        if toxic:
            for _ in range(rng.randint(1, 3)):
                words.insert(rng.randrange(len(words)), rng.choice(INSULTS))
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(toxic)))
    return rows, labels


def label_frame(spark, labels):
    df = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    return df.withColumns({c: F.lit("x") for c in CLASHING + ["text", "y", "fold"]})


def test_scores_separate_held_out_documents(spark):
    rows, labels = labelled()
    truth = {i: t for i, _, t in labels}
    extra = [(5000 + i if i is not None else None, t) for i, t in awkward_rows()]
    noise = [(3, 1, None), (None, 1, 1), (99999, 1, 1), (4, 1, 5), (8, 1, 1)]  # ignored, but for the repeated label
    docs = docs_frame(spark, rows + extra)
    got = toxicity_scores(docs, label_frame(spark, labels + noise), **FEW).collect()
    assert len(got) == len(rows) + len(extra)
    for r in got:
        key = "" if r["doc_id"] is None else str(r["doc_id"])
        assert r["held_out"] == (zlib.crc32(key.encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)
    held = [(truth[r["doc_id"]], r["score"], r["predicted"]) for r in got if r["held_out"] and r["doc_id"] in truth]
    assert np.mean([t == p for t, _, p in held]) > 0.95
    bad, good = [s for t, s, _ in held if t], [s for t, s, _ in held if not t]
    assert np.mean([(a > b) + 0.5 * (a == b) for a in bad for b in good]) > 0.98
    kept = drop_toxic(docs, label_frame(spark, labels), **FEW)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] for r in kept.collect()), key=str) == sorted((r["doc_id"] for r in got if not r["predicted"]), key=str)


def test_only_the_text_enters_a_score(spark):
    rows, labels = labelled(300)
    model = fit_toxicity(docs_frame(spark, rows), label_frame(spark, labels), **FEW)
    other = spark.createDataFrame([(t, -i, "zz", "elsewhere") for i, t in rows], "text string, doc_id bigint, lang string, source string")
    mine = spark.createDataFrame(rows, "doc_id bigint, text string")
    a = {r["text"]: r["score"] for r in model.scored(mine).collect()}
    b = {r["text"]: r["score"] for r in model.scored(other).collect()}
    assert a == b


def test_lexicon_equals_brute_force(spark):
    rows, labels = labelled(300)
    truth = {i: float(t) for i, _, t in labels}
    frame = spark.createDataFrame([(t, truth[i]) for i, t in rows], "text string, y double").repartition(5)
    got = learn_lexicon(frame, 0.02, 3, 2.0)
    bad, good = [terms(t) for i, t in rows if truth[i]], [terms(t) for i, t in rows if not truth[i]]
    want = {}
    for w in set().union(*bad):
        p, q = sum(w in x for x in bad), sum(w in x for x in good)
        odds = np.log((p + 0.5) / (len(bad) - p + 0.5)) - np.log((q + 0.5) / (len(good) - q + 0.5))
        if p >= max(3, 0.02 * len(bad)) and odds >= 2:
            want[w] = odds
    assert got.keys() == want.keys() and all(abs(got[w] - want[w]) < 1e-9 for w in want)
    assert set(INSULTS) | {"knave-"} <= got.keys()


def test_features():
    lexicon = {"wretch": 5.0, "knave-": 3.0}
    assert text_features(None, lexicon) == text_features("", lexicon) == [0.0] * len(FEATURES)
    f = dict(zip(FEATURES, text_features("YOU wretch! you Knavebert?? w.r3tch w r e t c h", lexicon)))
    assert f["word_hits"] == np.log1p(1) and f["stem_hits"] == np.log1p(1) and f["you_nearness"] == 0.5
    assert f["disguised"] > 0 and f["exclaimed"] > 0 and f["shouted"] > 0 and f["disguised_hits"] > 0
    assert "wretch" in undisguised("wr3tch") and "wretch" in undisguised("w r e t c h")
    assert all(np.isfinite(text_features(t, lexicon)).all() for _, t in awkward_rows())


def test_without_labels_of_both_classes(spark):
    rows, labels = labelled(60)
    docs = docs_frame(spark, rows)
    none = toxicity_scores(docs, label_frame(spark, [])).collect()
    assert {r["score"] for r in none} == {0.0}
    clean = toxicity_scores(docs, label_frame(spark, [x for x in labels if not x[2]])).collect()
    assert {r["score"] for r in clean} == {0.0}
    assert toxicity_scores(docs_frame(spark, []), label_frame(spark, labels)).collect() == []
