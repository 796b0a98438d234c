import random

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from .fixtures import CLASHING, awkward_rows, docs_frame, prose
from .test_simhash import brute_fingerprint
from .test_toxicity import labelled


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    """A small corpus with planted toxic texts, copies and benchmark passages."""
    folder = str(tmp_path_factory.mktemp("sf"))
    rng = random.Random(8)
    rows, labels = labelled(400)
    items = [(i, prose(rng, 30)) for i in range(8)]
    rows += [(1000 + i, rows[i * 4 + 1][1]) for i in range(20)]  # copies of clean documents
    rows += [(2000 + i, prose(rng, 20) + " " + items[i % 8][1] + " " + prose(rng, 20)) for i in range(16)]
    rows += [(3000 + i if i is not None else None, t) for i, t in awkward_rows()]
    docs_frame(spark, rows).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder


def test_stages_and_their_order():
    from echoset.llm import queries

    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash_near_dedup", "decontamination", "mixing", "token_files"]
    numbers = sorted(int(q[2:].split("_")[0]) for q in queries.QUERIES)
    assert numbers == list(range(1, 14))


def test_run_equals_its_stages_by_brute_force(spark, sf_dir):
    from echoset.llm.decontam import contamination
    from echoset.llm.mixing import mix_documents
    from echoset.llm.toxicity import toxicity_scores

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    at = docs
    kept = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, at, sf_dir)
        assert out.columns == corpus_pipeline.DOCUMENT_COLUMNS
        rows = [(r["doc_id"], r["text"]) for r in out.collect()]
        before = [(r["doc_id"], r["text"]) for r in at.collect()]
        if name == "toxicity":
            scores = toxicity_scores(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).collect()
            want = [r["doc_id"] for r in scores if not r["predicted"]]
            assert sum(r["predicted"] for r in scores if (r["doc_id"] or 0) < 400) > 80
        elif name == "simhash_near_dedup":
            least = {}
            for i, t in before:
                if i is not None:
                    least.setdefault(brute_fingerprint(t), set()).add(i)
            close = list(least)
            named = {min(min(least[q]) for q in close if (p ^ q).bit_count() <= 2) for p in close}
            assert {i for i, _ in rows if i is not None} <= {i for s in least.values() for i in s}
            want = None
            assert len(rows) <= len(before) - 20 and named >= {i for i, _ in rows if i is not None and i < 3000} - {2000}
        elif name == "decontamination":
            bad = {r["doc_id"] for r in contamination(at, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).collect() if r["contaminated"]}
            want = [i for i, _ in before if i not in bad]
            assert {2000 + i for i in range(16)} & {i for i, _ in before} <= bad
        else:
            want = [r["doc_id"] for r in mix_documents(at).collect() if r["kept"]]
        if want is not None:
            assert sorted((i for i, _ in rows), key=str) == sorted(want, key=str)
        at = spark.createDataFrame([(i, t, *rest) for i, t, *rest in out.collect()], out.schema)
        kept = rows
    result = corpus_pipeline.run(spark, sf_dir).collect()
    assert sorted((r["doc_id"] for r in result), key=str) == sorted((i for i, _ in kept), key=str)


def test_stages_on_empty_documents(spark, sf_dir):
    empty = spark.read.parquet(f"{sf_dir}/documents.parquet").where(F.lit(False))
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, sf_dir).collect() == []
    assert set(CLASHING) <= set(empty.columns)
