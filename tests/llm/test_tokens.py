import random
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from echoset.llm.tokens import Encoder, Part, read_manifest, read_token_files, token_files, write_token_files

from .fixtures import awkward_rows, docs_frame

BYTES, PIECES = (public_tokenizers.path(f) for f in ("byte_bpe_50k.json", "word_bpe_49k.json"))
ALPHABETS = [
    ["a", "b", "'s", " ", " ", "\n", ".", ",", "»", "\t", "\x1c", "\xa0", "　", "<|endoftext|>", "é", "12", "!", "\0", "ſ", "​", "😀", "the", '"'],
    ["a", "é", " b", ",", " c", ". D", ".\nE", "'t", " 1.", " it's,", ".", ",", "»"],
]


@pytest.mark.parametrize("path", [BYTES, PIECES])
@pytest.mark.parametrize("alphabet", ALPHABETS)
def test_words_give_the_whole_texts_ids(path, alphabet):
    rng = random.Random(1)
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 14))) for _ in range(4000)]
    want = [e.ids for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]
    enc = Encoder(path)
    for lo in range(0, len(texts), 700):
        ids, counts = enc(pa.array([None, *texts[lo:lo + 700]]).slice(1), 2)
        got = np.split(ids, np.cumsum(counts)[:-1])
        assert [g.tolist() for g in got] == [w + [2] for w in want[lo:lo + 700]]


def test_forgetting_words_changes_nothing(monkeypatch):
    monkeypatch.setattr("echoset.llm.tokens.CACHE_WORDS", 50)
    texts = [t or "" for _, t in awkward_rows()]
    want = [e.ids for e in Tokenizer.from_file(BYTES).encode_batch(texts, add_special_tokens=False)]
    enc = Encoder(BYTES)
    for _ in range(3):
        for t, w in zip(texts, want):
            assert enc(pa.array([t]))[0].tolist() == w


def test_files_round_trip(spark, tmp_path):
    rows = [r for r in awkward_rows()]
    folder = str(tmp_path / "tokens")
    manifest = write_token_files(docs_frame(spark, rows), folder, BYTES, 2, parts=4)
    assert read_manifest(folder) == manifest
    tok = Tokenizer.from_file(BYTES)
    ids = {t: tok.encode(t or "", add_special_tokens=False).ids + [2] for _, t in rows}
    got, seen = [], []
    for p in manifest["parts"]:
        part = Part(folder, p["name"], manifest["dtype"])
        assert p["base_docs"] == len(got) and p["base_ids"] == sum(map(len, seen))
        for i in range(len(part.docs)):
            got.append(int(part.docs[i]))
            seen.append(part.ids_of(i).tolist())
    assert got == sorted(-(1 << 63) if i is None else i for i, _ in rows)
    assert sorted(map(str, seen)) == sorted(str(ids[t]) for _, t in rows)
    back = read_token_files(spark, folder).collect()
    assert [(r["n_tokens"], r["ids_crc32"]) for r in sorted(back, key=lambda r: r["start"])] == [
        (len(s), zlib.crc32(np.array(s, "<u4").tobytes())) for s in seen]
    starts = sorted(r["start"] for r in back)
    assert starts == list(np.cumsum([0] + [len(s) for s in seen[:-1]]))
    assert sum(r["doc_id"] is None for r in back) == 2


def test_empty_table(spark):
    assert token_files(docs_frame(spark, []), BYTES).collect() == []


def test_ids_must_be_integers(spark):
    with pytest.raises(ValueError):
        token_files(spark.createDataFrame([("a", "b")], "doc_id string, text string"), BYTES)
