import duckdb
import numpy as np
import pytest

from echoset.plans.catalog import ORACLES, QUERIES


def same_as_oracle(spark, folder, name, table):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{folder}/{table}.parquet/*.parquet')")
    res = con.execute(ORACLES[name])
    cols = [d[0] for d in res.description]
    want = sorted(res.fetchall(), key=str)
    got = QUERIES[name](spark, str(folder))
    assert sorted(got.columns) == sorted(cols)
    rows = sorted((tuple(r) for r in got.select(*cols).collect()), key=str)
    assert rows == want
    return [dict(zip(cols, r)) for r in rows]


@pytest.fixture
def vectors(spark, tmp_path):
    """40 labels of 30 vectors; in every label, vectors 0, 10 and 20 are equal."""
    rng = np.random.default_rng(3)
    rows = []
    for label in range(40):
        x = rng.normal(size=(30, 64)).astype("float32")
        x[10] = x[20] = x[0]
        rows += [(f"l{label}", label * 1000 + i, v.tolist()) for i, v in enumerate(x)]
    spark.createDataFrame(rows, "label string, vec_id bigint, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    return tmp_path


def test_copies_of_lines_have_rows(spark, tmp_path):
    text = "the cat sat on the mat\nalone here\nthe cat sat on the mat\nThe cat sat on a mat\nthe cat sat on the mat"
    spark.createDataFrame([(1, text), (2, "one\none\ntwo")], "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = same_as_oracle(spark, tmp_path, "line_pair_members", "documents")
    seen = {(r["doc_id"], r["semid"]): (r["first_semid"], r["copies"], r["links"]) for r in rows}
    assert seen[1, 5][:2] == (1, 3) and seen[1, 5] == seen[1, 1] and seen[1, 2] == (2, 1, 0)
    assert seen[2, 2] == (1, 2, 1) and seen[2, 3] == (3, 1, 0) and len(seen) == 8


def test_copies_of_vectors_have_rows(spark, vectors):
    rows = same_as_oracle(spark, vectors, "embedding_pair_members", "embeddings")
    assert len(rows) == 1200 and sum(r["copies"] == 3 for r in rows) == 120
    assert all(r["links"] >= 2 for r in rows if r["vec_id"] % 10 == 0)


def test_most_labels_are_grouped(spark, vectors):
    rows = same_as_oracle(spark, vectors, "embedding_outcomes_by_label", "embeddings")
    done = [r for r in rows if r["status"] == "COMPLETED"]
    assert len(rows) == 40 and 20 < len(done) < 40 and all(r["n_groups"] > 0 for r in done)
