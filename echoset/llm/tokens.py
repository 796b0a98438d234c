"""Token-ID files: flat unsigned integers plus 64-bit document offsets.

A folder holds, for each part k in ascending document order:

* ``part-k.ids``: the token ids of its documents, one after another, as
  little-endian uint16 (uint32 if the vocabulary needs it);
* ``part-k.offsets``: little-endian int64, the place of each document's first id
  counted from the part's first, and one more for the end;
* ``part-k.docs``: the documents' ids, little-endian int64 (null: the least int64);

and ``manifest.json`` with the type and each part's base: the ids and
documents of all parts before it, the prefix sums of the parts' counts. A
document's place in the whole is base + offset; readers memory-map.

Parts are written where the texts lie after one range exchange by document
id, batch by batch, under a name of the attempt's own and then renamed: a lost
or repeated task writes the same bytes again.
"""

from __future__ import annotations

import json
import os
import re
import uuid
import zlib
from array import array

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import picked
from .words import slices

CACHE_WORDS = 800_000  # words met lately that a worker remembers (memory and speed, never the result)
ENCODE_AT_ONCE = 20_000  # words or texts given to the tokenizer in one call
TEXT_BYTES = 1 << 24  # bytes of text handled at once; a longer text is alone
READ_DOCS = 5_000  # documents in one batch read back
NO_ID = -(1 << 63)


def open_folder(folder: str):
    """(pyarrow file system, path) of a folder any node can reach."""
    from pyarrow import fs

    if folder.startswith("file:"):
        folder = "/" + folder[len("file:"):].lstrip("/")
    if folder.startswith("/"):
        return fs.LocalFileSystem(), folder
    return fs.FileSystem.from_uri(folder)


# Byte-level pre-tokenizers treat these alike; next to a space they change where a piece ends.
_WHITE = r"\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_NOT_PLAIN = r"[\t-\r ][\t-\r ]|[\x1c-\x1f" + _WHITE + "]"
_ALNUM = np.zeros(256, bool)
_ALNUM[48:58] = _ALNUM[65:91] = _ALNUM[97:123] = True


def _gather(flat: np.ndarray, size: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The runs number ``at`` of ``flat`` (run i has size[i] entries), one after another."""
    lengths = size[at]
    total = int(lengths.sum())
    place = np.int32 if max(total, len(flat)) < 1 << 31 else np.int64
    shift = (np.cumsum(size) - size)[at] - (np.cumsum(lengths) - lengths)
    source = np.repeat(shift.astype(place), lengths)
    source += np.arange(total, dtype=place)
    return flat[source]


class Encoder:
    """A tokenizer that remembers words.

    A byte-level pre-tokenizer starts a new piece before a space between
    non-spaces, around a line feed between them, and between a letter or digit and the comma or
    full stop that ends a word; merges never cross pieces. So a plain text (no two
    white spaces together, no special token) is cut there, equal parts of a batch are
    found by Arrow, and only those not met before are encoded. Other texts, and all texts
    of other kinds of tokenizer, are encoded whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        spec = json.loads(self.tok.to_str())
        pre = spec.get("pre_tokenizer") or {}
        self.by_word = (
            pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
            and not spec.get("normalizer") and not spec.get("truncation") and not spec.get("padding")
        )
        special = [re.escape(t["content"]) for t in spec.get("added_tokens", [])]
        self.not_plain = "|".join([_NOT_PLAIN, *special])
        self.dtype = np.dtype("<u2" if self.tok.get_vocab_size(with_added_tokens=True) <= 1 << 16 else "<u4")
        self.code = "H" if self.dtype.itemsize == 2 else "I"
        # words met lately: their ids lie one after another in flat; age: the call that last met them
        self.words = pa.array([], pa.large_string())
        self.flat, self.size, self.age = np.empty(0, self.dtype), np.empty(0, np.int64), np.empty(0, np.int64)
        self.calls = 0

    def _encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and how many each has."""
        ids, size = array(self.code), []
        for lo in range(0, len(texts), ENCODE_AT_ONCE):
            for e in self.tok.encode_batch(texts[lo:lo + ENCODE_AT_ONCE], add_special_tokens=False):
                one = e.ids
                ids.extend(one)
                size.append(len(one))
        return np.frombuffer(ids, self.dtype) if len(ids) else np.empty(0, self.dtype), np.array(size, np.int64)

    def _look_up(self, words: pa.Array) -> np.ndarray:
        """Places of distinct words among ``self.words``, which takes in the new ones."""
        self.calls += 1
        if len(self.words) > CACHE_WORDS:  # forget those not met for the longest
            self._keep(np.flatnonzero(self.age > np.quantile(self.age, 0.5)))
        at = pc.fill_null(pc.index_in(words, value_set=self.words), -1).to_numpy(zero_copy_only=False).copy()
        new = np.flatnonzero(at < 0)
        added = words.take(pa.array(new))
        flat, size = self._encode(added.to_pylist())
        at[new] = len(self.words) + np.arange(len(new))
        self.words = pa.concat_arrays([self.words, added])
        self.flat, self.size = np.concatenate([self.flat, flat]), np.concatenate([self.size, size])
        self.age = np.concatenate([self.age, np.zeros(len(new), np.int64)])
        self.age[at] = self.calls
        return at

    def _keep(self, at: np.ndarray) -> None:
        self.flat = _gather(self.flat, self.size, at)
        self.words, self.size, self.age = self.words.take(pa.array(at)), self.size[at], self.age[at]

    def __call__(self, texts: pa.Array, end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of all texts one after another, and the number of ids of each."""
        n = len(texts)
        texts = pc.fill_null(texts, "").cast(pa.large_string())
        if not self.by_word:
            flat, size = self._encode(texts.to_pylist())
            at = doc = np.arange(n)
        else:
            plain = ~pc.match_substring_regex(texts, self.not_plain).to_numpy(zero_copy_only=False)
            parts, doc = self._cut(texts, plain)
            coded = pc.dictionary_encode(parts)
            at = self._look_up(coded.dictionary)[coded.indices.to_numpy(zero_copy_only=False)]
            flat, size = self.flat, self.size
        if end is not None:  # one more part after each text's
            after = np.searchsorted(doc, np.arange(n), "right")
            at, doc = np.insert(at, after, len(size)), np.insert(doc, after, np.arange(n))
            flat, size = np.append(flat, self.dtype.type(end)), np.append(size, 1)
        return _gather(flat, size, at), np.bincount(doc, size[at], n).astype(np.int64)

    def _cut(self, texts: pa.Array, plain: np.ndarray) -> tuple[pa.Array, np.ndarray]:
        """The parts of all texts (slices of their bytes, not copied) and the text of each."""
        _, offsets, data = texts.buffers()
        bounds = np.frombuffer(offsets, np.int64)[texts.offset:texts.offset + len(texts) + 1]
        lo, hi = int(bounds[0]), int(bounds[-1])
        b = np.frombuffer(data, np.uint8)[lo:hi] if data is not None else np.empty(0, np.uint8)
        starts = np.zeros(len(b) + 1, bool)
        if plain.any():
            gap = (b == 32) | (b == 10)
            starts[:-1] |= gap
            starts[1:] |= b == 10
            if len(b) > 1:
                stops = np.append(gap[1:], True)
                stops[bounds[1:][bounds[1:] > lo] - lo - 1] = True  # the last byte of a text
                starts[1:-1] |= ((b[1:] == 44) | (b[1:] == 46)) & stops[1:] & _ALNUM[b[:-1]]
            if not plain.all():
                starts &= np.append(np.repeat(plain, np.diff(bounds)), False)
        starts[bounds - lo] = True
        starts[-1] = True
        places = np.flatnonzero(starts).astype(np.int64)
        doc = np.searchsorted(bounds - lo, places[:-1], "right") - 1
        parts = pa.Array.from_buffers(
            pa.large_string(), max(0, len(places) - 1), [None, pa.py_buffer(places + lo), data if data is not None else pa.py_buffer(b"")])
        return parts, doc


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder for a tokenizer file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def write_token_files(
    docs: DataFrame, folder: str, tokenizer_path: str, end_id: int | None, id_col: str = "doc_id",
    text_col: str = "text", parts: int | None = None,
) -> dict:
    """Write the files of all documents in ascending id order; returns the manifest.

    Null texts count as empty; ``end_id`` (if any) ends every document. Ids
    must be integers; rows with a null id come first, rows that share an id
    stand in the order of their texts' hash and text. An empty table gives a manifest
    without parts. ``parts`` defaults to ``spark.sql.shuffle.partitions``.
    """
    spark = docs.sparkSession
    src = picked(docs, id=id_col, text=text_col)
    if src.schema["id"].dataType.simpleString() not in ("bigint", "int", "smallint", "tinyint"):
        raise ValueError("document ids must be integers")
    if end_id is not None and end_id >= encoder(tokenizer_path).tok.get_vocab_size(with_added_tokens=True):
        raise ValueError("end_id is not in the vocabulary")
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = (
        src.select(F.col("id").cast("bigint"), F.coalesce("text", F.lit("")).alias("text"))
        .withColumn("tie", F.xxhash64("text"))
        .repartitionByRange(parts, "id", "tie").sortWithinPartitions("id", "tie", "text")
        .select("id", "text")
    )

    def write(it):
        enc, files = None, None
        n_docs = n_ids = 0
        for batch in it:
            if enc is None:
                enc = encoder(tokenizer_path)
                fs, path = open_folder(folder)
                task = TaskContext.get()
                name = f"part-{task.partitionId():06d}"
                fs.create_dir(path, recursive=True)
                own = f"{path}/.{name}-{task.taskAttemptId()}"
                files = {x: fs.open_output_stream(f"{own}.{x}") for x in ("ids", "offsets", "docs")}
                files["offsets"].write(np.zeros(1, "<i8").tobytes())
            for lo, hi in slices(batch.column(1), TEXT_BYTES):
                ids, counts = enc(batch.column(1).slice(lo, hi - lo), end_id)
                files["ids"].write(ids.tobytes())
                ends = n_ids + np.cumsum(counts)
                files["offsets"].write(ends.astype("<i8").tobytes())
                files["docs"].write(pc.fill_null(batch.column(0).slice(lo, hi - lo), NO_ID).to_numpy(zero_copy_only=False).astype("<i8").tobytes())
                n_docs, n_ids = n_docs + len(counts), int(ends[-1])
        if files:
            for x, f in files.items():
                f.close()
                fs.move(f"{own}.{x}", f"{path}/{name}.{x}")
            yield pa.RecordBatch.from_pydict({"name": [name], "dtype": [enc.dtype.str], "docs": [n_docs], "ids": [n_ids]})

    written = ordered.mapInArrow(write, "name string, dtype string, docs bigint, ids bigint").collect()  # a row a part
    manifest = {"dtype": written[0]["dtype"] if written else "<u2", "end_id": end_id, "parts": []}
    base_docs = base_ids = 0
    for row in sorted(written, key=lambda r: r["name"]):
        manifest["parts"].append({"name": row["name"], "docs": row["docs"], "ids": row["ids"], "base_docs": base_docs, "base_ids": base_ids})
        base_docs, base_ids = base_docs + row["docs"], base_ids + row["ids"]
    fs, path = open_folder(folder)
    fs.create_dir(path, recursive=True)
    with fs.open_output_stream(f"{path}/manifest.json") as f:
        f.write(json.dumps(manifest).encode())
    return manifest


def read_manifest(folder: str) -> dict:
    fs, path = open_folder(folder)
    with fs.open_input_file(f"{path}/manifest.json") as f:
        return json.loads(f.read())


def _mapped(fs, path: str, dtype: np.dtype) -> np.ndarray:
    """A file as an array: memory-mapped where the file system is local."""
    if fs.type_name == "local":
        return np.memmap(path, dtype, "r") if os.path.getsize(path) else np.empty(0, dtype)
    with fs.open_input_file(path) as f:
        return np.frombuffer(f.read(), dtype)


class Part:
    """One part, opened for reading: ``ids_of(i)`` gives the i-th document's token ids."""

    def __init__(self, folder: str, name: str, dtype: str):
        fs, path = open_folder(folder)
        self.ids = _mapped(fs, f"{path}/{name}.ids", np.dtype(dtype))
        self.offsets = _mapped(fs, f"{path}/{name}.offsets", np.dtype("<i8"))
        self.docs = _mapped(fs, f"{path}/{name}.docs", np.dtype("<i8"))

    def ids_of(self, i: int) -> np.ndarray:
        return self.ids[self.offsets[i]:self.offsets[i + 1]]


def read_token_files(spark: SparkSession, folder: str, id_col: str = "doc_id") -> DataFrame:
    """One row per document, from the files: ``<id_col>``, ``start``, ``n_tokens``, ``ids_crc32``.

    ``start`` counts the ids of all documents before it; ``ids_crc32`` is the
    unsigned crc32 of its ids as little-endian unsigned 32-bit integers.
    """
    manifest = read_manifest(folder)
    dtype = manifest["dtype"]
    rows = [(p["name"], p["base_ids"]) for p in manifest["parts"]]
    listed = spark.createDataFrame(rows, "name string, base bigint").repartition(max(1, len(rows)), "name")

    def read(it):
        for pdf in it:
            for name, base in zip(pdf["name"], pdf["base"]):
                part = Part(folder, name, dtype)
                for lo in range(0, len(part.docs), READ_DOCS):
                    hi = min(lo + READ_DOCS, len(part.docs))
                    at = np.asarray(part.offsets[lo:hi + 1])
                    crc = [zlib.crc32(part.ids_of(i).astype("<u4").tobytes()) for i in range(lo, hi)]
                    ids = pd.Series(np.asarray(part.docs[lo:hi]), dtype="Int64")
                    yield pd.DataFrame({
                        "id": ids.mask(ids == NO_ID), "start": base + at[:-1], "n_tokens": np.diff(at),
                        "ids_crc32": np.array(crc, np.int64),
                    })

    return listed.mapInPandas(read, "id bigint, start bigint, n_tokens bigint, ids_crc32 bigint").withColumnRenamed("id", id_col)


def token_files(docs: DataFrame, tokenizer_path: str, end_id: int | None = 2, folder: str | None = None, **kw) -> DataFrame:
    """Write the files (by default in a new folder beside the checkpoints) and read them back."""
    spark = docs.sparkSession
    folder = folder or f"{spark.sparkContext.getCheckpointDir()}/tokens-{uuid.uuid4().hex}"
    write_token_files(docs, folder, tokenizer_path, end_id, **kw)
    return read_token_files(spark, folder, kw.get("id_col", "doc_id"))
