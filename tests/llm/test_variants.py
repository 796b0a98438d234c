import random
import re
import zlib
from collections import Counter

import pytest

from echoset.llm.variants import LETTERS, near_words, spelling_variants, symbols_for

from .fixtures import awkward_rows, docs_frame


def brute_words(rows, min_length, min_count, noise):
    count = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if noise and h % noise == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            if len(run) >= min_length:
                count[run] += 1
    return {w: n for w, n in count.items() if n >= min_count}


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute(rows, min_length=6, min_count=5, noise=199, ratio=5):
    n = brute_words(rows, min_length, min_count, noise)
    near = {a: [b for b in n if one_edit(a, b)] for a in n}
    form = {}
    for a, bs in near.items():
        best = min(bs, key=lambda b: (-n[b], b), default=None)
        form[a] = best if best is not None and n[best] >= ratio * n[a] else None
    out = []
    for a in n:
        root = a
        while form[root] is not None:
            root = form[root]
        out.append((a, n[a], len(near[a]), form[a], n[form[a]] if form[a] else None, root))
    return sorted(out, key=str)


COLUMNS = ["word", "n", "n_near", "form", "form_n", "root"]


def found(df):
    return sorted([tuple(r) for r in df.select(*COLUMNS).collect()], key=str)


def spelled(rng, base, times):
    """Texts in which words are sometimes misspelt, and misspellings too."""
    letters = "abcdehstuéñßÿ"
    rows = []
    for i in range(times):
        words = []
        for w in rng.choices(base, weights=range(1, len(base) + 1), k=60):
            while rng.random() < 0.25:
                at = rng.randrange(len(w))
                w = rng.choice([w[:at] + w[at + 1:], w[:at] + rng.choice(letters) + w[at:], w[:at] + rng.choice(letters) + w[at + 1:]])
            words.append(rng.choice([w, w, w.upper(), w.capitalize()]))
        rows.append((i, rng.choice([" ", ", ", "7", "-"]).join(words)))
    return rows


def test_equal_brute_force(spark):
    rng = random.Random(2)
    base = ["harbour", "harbours", "colour", "colours", "señorita", "straße", "whisky", "whiskey", "h×÷teller"] + [
        "".join(rng.choice("abc") for _ in range(rng.randint(6, 8))) for _ in range(40)]
    rows = spelled(rng, base, 150) + awkward_rows()
    got = found(spelling_variants(docs_frame(spark, rows)))
    assert got == brute(rows)
    assert sum(1 for r in got if r[3]) > 10


@pytest.mark.parametrize("symbols,long,noise", [(4, 48, None), (9, 7, 3), (5, 6, 199)])
def test_symbols_and_the_bound_of_long_words_do_not_show(spark, symbols, long, noise):
    rng = random.Random(symbols)
    rows = spelled(rng, ["".join(rng.choice("abé") for _ in range(rng.randint(5, 10))) for _ in range(25)], 60)
    got = found(spelling_variants(docs_frame(spark, rows), min_count=2, ratio=2, noise=noise, symbols=symbols, long=long))
    assert got == brute(rows, min_count=2, ratio=2, noise=noise)


def test_very_long_words(spark):
    rng = random.Random(8)
    stem = "".join(rng.choice(LETTERS) for _ in range(20_000))
    words = [stem, stem[1:], stem[:-1], stem[:9_999] + stem[10_000:], stem[:5] + "q" + stem[5:], stem[:10_000] + "zz" + stem[10_002:]]
    words += [w for n in (47, 48, 49, 50) for w in ("ab" * 40)[:n].split()]
    df = spark.createDataFrame([(w,) for w in words], "word string")
    got = [tuple(r) for r in near_words(df, 4).collect()]
    assert len(got) == len(set(got)) and set(got) == {(a, b) for a in words for b in words if one_edit(a, b)}


def test_roots_follow_long_chains(spark):
    chain = ["aaaaaa" + "b" * i for i in range(6)]
    rows = [(i, (w + " ") * 3 ** i) for i, w in enumerate(chain)]
    got = found(spelling_variants(docs_frame(spark, rows), min_count=1, ratio=3, noise=None))
    assert got == brute(rows, min_count=1, ratio=3, noise=None) and {r[5] for r in got} == {chain[-1]}


def test_empty_and_letterless(spark):
    assert spelling_variants(docs_frame(spark, [])).collect() == []
    assert spelling_variants(docs_frame(spark, [(1, None), (2, ""), (3, "12 34 !!"), (4, "short few")])).collect() == []


def test_symbols_follow_the_vocabulary():
    assert symbols_for(0) == 4 and symbols_for(10**5) == 7 and symbols_for(10**30) == len(LETTERS)
