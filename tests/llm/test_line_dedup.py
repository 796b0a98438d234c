import random
from collections import defaultdict

from echoset.llm.line_dedup import remove_spread_lines

from .fixtures import awkward_rows, docs_frame, prose


def brute(rows, min_sites, min_chars):
    sites = defaultdict(set)
    for _, text, site in rows:
        for line in (text or "").split("\n"):
            bare = line.strip(" \t\r")
            if len(bare) >= min_chars and site is not None:
                sites[bare].add(site)
    out = []
    for i, text, _ in rows:
        if text is None:
            out.append((i, None, 0, 0))
            continue
        lines = text.split("\n")
        kept = [x for x in lines if len(x.strip(" \t\r")) < min_chars or len(sites[x.strip(" \t\r")]) < min_sites]
        out.append((i, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=str)


def rows_with_boilerplate():
    rng = random.Random(2)
    boiler = [prose(rng, 8) for _ in range(6)]
    rows = []
    for i in range(120):  # boiler[k] stands on 2, 4, 5, 6, 7 and 9 sites
        lines = [prose(rng, 6) for _ in range(rng.randint(0, 4))]
        for b, spread in zip(boiler, (2, 4, 5, 6, 7, 9)):
            if rng.random() < 0.5 and i % 9 < spread:
                lines.insert(rng.randint(0, len(lines)), rng.choice(["", " ", "\t"]) + b + rng.choice(["", "\r"]))
        lines.insert(rng.randint(0, len(lines)), "short line")
        rows.append((i, "\n".join(lines) + rng.choice(["", "\n"]), f"site{i % 9}"))
    rows += [(200 + i, t, f"site{i % 9}" if i % 5 else None) for i, (_, t) in enumerate(awkward_rows())]
    rows += [(400, "\n".join(boiler * 3000), "site1"), (401, "\n".join(boiler), None), (None, boiler[5], "site0"), (None, None, None)]
    rows += [(402, boiler[5], "site1"), (402, boiler[5], "site1")]
    return rows


def frame(spark, rows):
    docs = docs_frame(spark, [r[:2] for r in rows], source=False)
    plain = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    extra = [c for c in docs.columns if c not in ("doc_id", "text")]
    from pyspark.sql import functions as F

    return plain.withColumns({c: F.lit("x") for c in extra})


def test_equals_exact_counts(spark):
    rows = rows_with_boilerplate()
    for min_sites, band in ((5, 0.25), (6, 0.0), (3, 0.9)):
        got = remove_spread_lines(frame(spark, rows), min_sites=min_sites, min_chars=12, band=band, broadcast_keys=0 if band < 0.3 else 200_000)
        assert sorted((tuple(r) for r in got.collect()), key=str) == brute(rows, min_sites, 12)


def test_no_python_on_the_main_path(spark):
    plan = remove_spread_lines(frame(spark, rows_with_boilerplate()))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


def test_empty_table(spark):
    assert remove_spread_lines(frame(spark, [])).collect() == []


def test_short_lines_count_by_default(spark):
    rows = [(i, f"All rights reserved.\n\nstory {i}\n ok\t", f"site{i % 9}") for i in range(9)] + [(9, "few\n", "site1"), (10, "few", "site2")]
    got = remove_spread_lines(frame(spark, rows))
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(rows, 8, 1)
    assert brute(rows, 8, 1)[0] == (0, "\nstory 0", 4, 2)
