"""Texts to unit vectors.

Encoders
--------
``hashing``      built-in, deterministic: every word of
                 the normalised text (lower-cased) goes to bucket
                 ``int(md5(word)[:8], 16) mod dim``. The whole text is used.
                 The result is sparse: ``idx array<int>`` (ascending), ``cnt
                 array<bigint>`` and the squared norm ``sq``, all integers.
                 Counted where the rows lie by an Arrow UDF (sort, then run
                 boundaries), so it needs no shuffle.
``precomputed``  vectors already in a table (``array<float|double>``).
``model``        a user-supplied ONNX model directory (optional plug-in):
                 token ids are built with Spark expressions (T2-T5), the model
                 runs in ``mapInPandas`` in Arrow batches, pooling and
                 normalisation follow (T7, T8, T9).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

DEFAULT_DIM = 4096

# Fixed values of the reference's token framing (T2-T4):
#   fallback ids  [UNK] 100, [CLS] 101, [SEP] 102
#   sequence limit 512 ids in total, so at most 510 words
UNK_ID, CLS_ID, SEP_ID = 100, 101, 102
MAX_SEQ_LENGTH = 512
MAX_WORDS = MAX_SEQ_LENGTH - 2


HASHED_BYTES = 1_000_000  # text split into words at once


def _hashed(texts: pa.Array, dim: int) -> pa.StructArray:
    """Buckets, counts and squared norm of some lower-cased texts; a word is hashed once, however often it occurs."""
    words = pc.ascii_split_whitespace(texts)
    row = np.repeat(np.arange(len(texts)), words.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
    coded = words.flatten().dictionary_encode()
    spelled = coded.dictionary.cast(pa.binary()).to_pylist()
    digests = np.frombuffer(b"".join([hashlib.md5(w).digest() for w in spelled]), ">u4")
    at = coded.indices.to_numpy(zero_copy_only=False)
    b = (digests[::4].astype(np.int64) % dim)[at]
    word = np.array([w != b"" for w in spelled], bool)[at]  # not the empty piece before leading or after trailing space
    key = np.sort(row[word] * dim + b[word])
    first = np.flatnonzero(np.diff(key, prepend=-1))
    cnt = np.diff(first, append=len(key))
    row, idx = np.divmod(key[first], dim)
    ends = np.searchsorted(row, np.arange(len(texts) + 1))
    so_far = np.concatenate([[0], np.cumsum(cnt * cnt)])
    offsets = pa.array(ends, pa.int32())
    return pa.StructArray.from_arrays([
        pa.ListArray.from_arrays(offsets, pa.array(idx, pa.int32())), pa.ListArray.from_arrays(offsets, pa.array(cnt, pa.int64())),
        pa.array(so_far[ends[1:]] - so_far[ends[:-1]], pa.int64())], names=["idx", "cnt", "sq"])


def hashed_words(text: Column, dim: int = DEFAULT_DIM) -> Column:
    """``idx``, ``cnt`` and ``sq`` of each text: word to bucket by the first 8 hex digits of md5(lower(word)) mod dim.

    Lower case is the JVM's, words and their numbers are counted in Arrow batches,
    about a million bytes of text at once.
    """
    def run(texts: pa.Array) -> pa.Array:
        stretch = np.cumsum(pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False)) // HASHED_BYTES
        cuts = [0, *(np.flatnonzero(np.diff(stretch)) + 1), len(texts)]
        return pa.concat_arrays([_hashed(texts.slice(at, end - at), dim) for at, end in zip(cuts, cuts[1:])])

    return F.arrow_udf(run, "struct<idx:array<int>,cnt:array<bigint>,sq:bigint>")(F.lower(text))


def with_hashing_counts(df: DataFrame, text_col: str = "text", dim: int = DEFAULT_DIM) -> DataFrame:
    """Adds ``idx`` (buckets, ascending), ``cnt`` (words in each) and ``sq`` (sum of squared counts).

    Integers, so similarities computed from them do not depend on strategy or
    summation order (T1, T10: each row is embedded where it is).
    """
    return df.withColumn("_h", hashed_words(F.col(text_col), dim)).select(*df.columns, "_h.idx", "_h.cnt", "_h.sq")


def with_hashing_vectors(df: DataFrame, text_col: str = "text", dim: int = DEFAULT_DIM) -> DataFrame:
    """Adds the unit vector ``idx`` and ``w`` of the counts."""
    counted = with_hashing_counts(df, text_col, dim)
    norm = F.sqrt(F.col("sq").cast("double"))
    w = F.zip_with("cnt", F.array_repeat(norm, F.size("cnt")), lambda c, z: c.cast("double") / z)
    return counted.select(*df.columns, "idx", w.alias("w"))


def explode_sparse(df: DataFrame, keys: list[str]) -> DataFrame:
    """``(keys..., bucket int, weight double)`` rows of a sparse vector table."""
    return df.select(*keys, F.explode(F.arrays_zip("idx", "w")).alias("_f")).select(
        *keys, F.col("_f.idx").alias("bucket"), F.col("_f.w").alias("weight"))


def l2_normalize(v: Column) -> Column:
    """Divide by the magnitude; a zero vector is returned unchanged."""
    vd = F.transform(v, lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate(vd, F.lit(0.0), lambda acc, x: acc + x * x))
    return F.when(norm > 0, F.transform(vd, lambda x: x / norm)).otherwise(vd)


def as_double_vector(v: Column) -> Column:
    return F.transform(v, lambda x: x.cast("double"))


# ------------------------------------------------------------------ model path

def token_ids(df: DataFrame, vocab: DataFrame, text_col: str = "text", key_cols: list[str] | None = None,
              max_words: int | None = None) -> DataFrame:
    """Model inputs from text with whole-word vocabulary lookup.

    ``vocab`` is ``(token string, id int)``. Words are split on whitespace,
    lower-cased and looked up whole (unknown -> ``[UNK]``); whole texts unless
    ``max_words`` is given (``MAX_WORDS`` for the reference's model); framed by ``[CLS]`` ... ``[SEP]``. Returns ``keys..., input_ids
    array<bigint>, attention_mask, token_type_ids``. The vocabulary join is
    an equi-join on the token (shuffle or broadcast, chosen by the planner
    from its size).
    """
    keys = key_cols or ["doc_id", "semid"]
    # at most three rows: the ids of the special tokens, if the vocabulary has them
    found = {r["token"]: r["id"] for r in
             vocab.where(F.col("token").isin("[UNK]", "[CLS]", "[SEP]")).groupBy("token").agg(F.max("id").alias("id")).collect()}
    unk, cls, sep = found.get("[UNK]", UNK_ID), found.get("[CLS]", CLS_ID), found.get("[SEP]", SEP_ID)
    words = df.select(*keys, F.posexplode(F.split(F.col(text_col), "\\s+")).alias("wpos", "word"))
    if max_words is not None:
        words = words.where(F.col("wpos") < max_words)
    looked = words.join(vocab.withColumnRenamed("token", "_tok"), F.lower(F.col("word")) == F.col("_tok"), "left")
    ids = looked.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct("wpos", F.coalesce(F.col("id").cast("bigint"), F.lit(unk).cast("bigint")).alias("tid")))).alias("_s"))
    out = ids.select(
        *keys,
        F.concat(F.array(F.lit(cls).cast("bigint")), F.transform("_s", lambda s: s["tid"]),
                 F.array(F.lit(sep).cast("bigint"))).alias("input_ids"),
    )
    n = F.size("input_ids")
    return out.withColumn("attention_mask", F.array_repeat(F.lit(1).cast("bigint"), n)).withColumn(
        "token_type_ids", F.array_repeat(F.lit(0).cast("bigint"), n))


def mean_pool(token_states: DataFrame, key: str = "id") -> DataFrame:
    """T7 + T8 over ``(key, states array<array<float>>)``: average every
    dimension over all tokens (markers included), then L2 normalise.

    Pure Spark, row by row: the token vectors already lie in the row and are
    folded in their order, so there is no shuffle and the sums never vary.
    """
    first = F.transform(F.element_at("states", 1), lambda x: F.lit(0.0))
    total = F.aggregate("states", first, lambda acc, tok: F.zip_with(acc, tok, lambda a, b: a + b.cast("double")))
    mean = F.transform(F.arrays_zip(total.alias("x"), F.array_repeat(F.size("states"), F.size(total)).alias("n")),
                       lambda z: z["x"] / z["n"])
    return token_states.select(key, mean.alias("_mean")).select(key, l2_normalize(F.col("_mean")).alias("vector"))


def model_encoder(model_dir: str, dim: int):
    """T6 + T9: ``mapInPandas`` function running an ONNX model per Arrow batch.

    The model is loaded once per Python worker; each text's token states are
    mean-pooled and normalised in numpy; a failing text yields a zero vector
    and an ``embed_error``. Import of ``onnxruntime`` is deferred to the
    executors, so the engine works without it.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import numpy as np
        import onnxruntime as ort  # optional dependency, executor side

        sess = ort.InferenceSession(f"{model_dir}/model.onnx", providers=["CPUExecutionProvider"])
        for pdf in batches:
            vecs, errs = [], []
            for ids in pdf["input_ids"]:
                try:
                    arr = np.asarray(ids, dtype=np.int64)[None, :]
                    feeds = {"input_ids": arr, "attention_mask": np.ones_like(arr), "token_type_ids": np.zeros_like(arr)}
                    states = sess.run(None, feeds)[0][0]
                    v = states.astype(np.float64).mean(axis=0)
                    nrm = np.sqrt((v * v).sum())
                    vecs.append((v / nrm if nrm > 0 else v).tolist())
                    errs.append(None)
                except Exception as exc:  # T9: failure -> zero vector, document continues
                    vecs.append([0.0] * dim)
                    errs.append(str(exc))
            out = pdf.drop(columns=["input_ids", "attention_mask", "token_type_ids"], errors="ignore")
            out["vector"] = vecs
            out["embed_error"] = errs
            yield out
    return run


def embed_with_model(tokens: DataFrame, model_dir: str, dim: int = 384) -> DataFrame:
    keys = [c for c in tokens.columns if c not in ("input_ids", "attention_mask", "token_type_ids")]
    schema = T.StructType([tokens.schema[k] for k in keys] + [
        T.StructField("vector", T.ArrayType(T.DoubleType(), False)),
        T.StructField("embed_error", T.StringType()),
    ])
    return tokens.mapInPandas(model_encoder(model_dir, dim), schema)
