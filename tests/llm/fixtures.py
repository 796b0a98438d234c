"""Small fixtures shared by the operators' tests: awkward rows and brute-force helpers."""

import random

# names the operators use inside; as extra columns they must not disturb anything
CLASHING = [
    "id", "fp", "row", "v", "kind", "start", "end", "score", "weight", "topic_", "host", "lines", "_id", "part", "guest",
    "cls", "n", "sketch", "probability", "features", "mark", "site", "found", "raw", "root", "least", "tie", "shard",
]
LONG_WORDS = 60_000


def prose(rng, n):
    syllables = ["an", "the", "ti", "ou", "re", "sch", "é", "ño", "li", "wor", "ka", "mu"]
    return " ".join("".join(rng.choice(syllables) for _ in range(rng.randint(1, 4))) for _ in range(n))


def awkward_rows(seed=5):
    """(doc_id, text): nulls, blanks, one very long text, ties, repeated rows, a null id."""
    rng = random.Random(seed)
    base = [prose(rng, rng.randint(1, 60)) for _ in range(40)]
    rows = [(i, t) for i, t in enumerate(base)]
    rows += [(100 + i, base[3]) for i in range(6)]  # copies
    rows += [(110, None), (111, ""), (112, " \n\t "), (113, "one"), (114, "one two")]
    rows += [(115, prose(rng, LONG_WORDS)), (116, "x" * 300_000)]
    rows += [(117, base[5].upper()), (118, base[5] + " tail"), (119, "naïve 😀   mixed　space")]
    rows += [(120, base[7]), (120, base[7]), (None, base[8]), (None, None)]  # repeated row, null ids
    return rows


def docs_frame(spark, rows, extra=True, source=True):
    """A ``documents`` table, with extra columns whose names clash with internal ones."""
    schema = "doc_id bigint, text string"
    if source:
        rows = [(*r, None if i % 11 == 4 else ["en", "de"][i % 2], None if i % 13 == 5 else f"src{i % 9}", 1) for i, r in enumerate(rows)]
        schema += ", lang string, source string, n_chars bigint"
    df = spark.createDataFrame(rows, schema)
    if extra:
        from pyspark.sql import functions as F

        df = df.withColumns({c: F.lit("extra") for c in CLASHING})
    return df


def union_find(n, pairs):
    """Smallest member of each element's component."""
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]
