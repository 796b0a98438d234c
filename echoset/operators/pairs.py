"""Thresholded similarity self-join within a scope.

Every pair function takes a *vertex* table: scope columns, an order column
``pos`` (unique inside a scope) and a vector, and returns the edge table::

    scope..., a, b, sim        (a < b, sim >= threshold, sim not NaN)

Strategies (all exact except J4):

* :func:`sparse_pairs` (J2c) — sparse hashed vectors. Inverted index on
  buckets with the all-pairs *prefix filter* (Bayardo, Ma, Srikant, WWW 2007):
  buckets are put in one global order, rarest first; a vector is indexed only
  under the shortest prefix whose remaining suffix has norm below the
  threshold. Two unit vectors with dot >= t must share a prefix bucket, so
  the candidate join never touches the common buckets that make a plain
  inverted index explode, and no bucket is ever dropped. Candidates are then
  scored exactly on the packed vectors.
* :func:`block_pairs` (J2b) — dense vectors, or sparse densified per block.
  Rows are hashed into blocks of bounded size inside their scope; each pair of
  blocks meets once in ``applyInPandas`` and is multiplied in numpy. Memory per
  task is bounded by the block size, never by the scope size.
* :func:`lsh_pairs` (J4) — approximate: cross-polytope hashing with multi-probe,
  verified; a subset of the exact edges, never extra ones.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from echoset.operators.embed import as_double_vector

PREFIX_EPS = 1e-9  # safety margin on the prefix bound (more candidates, never fewer)
DEFAULT_BLOCK_ROWS = 1024
LENGTH_ERROR = "vector lengths differ within a scope"


def cosine(a: Column, b: Column) -> Column:
    """dot(a, b) / (|a| |b|) in double; either norm 0 -> 0.0.

    Vectors of different length raise an error (they fail the document in
    the reference).
    """
    ad = F.transform(a, lambda x: x.cast("double"))
    bd = F.transform(b, lambda x: x.cast("double"))
    dot = F.aggregate(F.zip_with(ad, bd, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)
    na = F.sqrt(F.aggregate(ad, F.lit(0.0), lambda acc, x: acc + x * x))
    nb = F.sqrt(F.aggregate(bd, F.lit(0.0), lambda acc, x: acc + x * x))
    checked = F.when(F.size(a) != F.size(b), F.raise_error(F.lit(LENGTH_ERROR)))
    return F.coalesce(checked.cast("double"), F.when((na == 0) | (nb == 0), F.lit(0.0)).otherwise(dot / (na * nb)))


def _keep(sim: Column, threshold: float) -> Column:
    # inclusive threshold; NaN never qualifies (Spark orders NaN above numbers)
    return (sim >= F.lit(float(threshold))) & ~F.isnan(sim)


# --------------------------------------------------------------------- J2c

def sparse_pairs(vertices: DataFrame, scope: list[str], threshold: float, pos: str = "pos") -> DataFrame:
    """Exact edges of hashed count vectors (``idx``, ``cnt``, ``sq``), threshold > 0."""
    if not threshold > 0:
        raise ValueError("sparse_pairs needs a positive threshold; use block_pairs for t <= 0")
    verts = vertices.select(*scope, F.col(pos).alias("v"), "sq", "idx", "cnt")
    pre = _packed_prefixes(verts, scope, threshold)
    l, r = pre.alias("l"), pre.alias("r")
    on = [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in scope] + [
        F.col("l.bucket") == F.col("r.bucket"), F.col("l.v") < F.col("r.v")]
    cand = l.join(r, on).select(*[F.col(f"l.{c}").alias(c) for c in scope],
                                F.col("l.v").alias("a"), F.col("r.v").alias("b")).distinct()
    one = verts.select(*scope, F.col("v").alias("a"), F.col("sq").alias("sa"), F.col("idx").alias("ia"), F.col("cnt").alias("ca"))
    two = verts.select(*scope, F.col("v").alias("b"), F.col("sq").alias("sb"), F.col("idx").alias("ib"), F.col("cnt").alias("cb"))
    return _packed_scores(cand.join(one, scope + ["a"]).join(two, scope + ["b"]), scope, threshold)


PACKED_ROWS = 2048  # rows unpacked at once


def _lists(column) -> tuple[np.ndarray, np.ndarray]:
    """All values of a list column, and the row of each."""
    size = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    return column.flatten().to_numpy(zero_copy_only=False), np.repeat(np.arange(len(column)), size)


def _packed_prefixes(verts: DataFrame, scope: list[str], threshold: float) -> DataFrame:
    """Features ``(scope..., v, bucket)`` of each vector's rare-first prefix; only these leave a task.

    Buckets are ordered by (frequency, bucket), one number a bucket (as many as the dimension), known
    to every task. Seen from the common end, a feature belongs to the prefix
    once the squared norm up to it reaches t^2: what is left out has norm below t.
    """
    t2 = float(threshold) * float(threshold) * (1 - PREFIX_EPS)
    freq = verts.select(F.explode("idx").alias("bucket")).groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).toPandas().sort_values("bucket")
    buckets = freq["bucket"].to_numpy()
    place = np.empty(len(buckets), np.int64)  # common first
    place[np.lexsort((-buckets.astype(np.int64), -freq["n"].to_numpy().astype(np.int64)))] = np.arange(len(buckets))
    schema = T.StructType([*[verts.schema[c] for c in scope], verts.schema["v"], T.StructField("bucket", T.IntegerType())])

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for at in range(0, batch.num_rows, PACKED_ROWS):
                part = batch.slice(at, PACKED_ROWS)
                idx, row = _lists(part.column("idx"))
                if not len(idx):
                    continue
                c = _lists(part.column("cnt"))[0].astype(np.int64)
                order = np.lexsort((place[np.searchsorted(buckets, idx)], row))
                row, idx, so_far = row[order], idx[order], np.cumsum((c * c)[order])
                first = np.searchsorted(row, row)  # where the row's features begin
                so_far -= np.concatenate([[0], so_far])[first]
                keep = so_far >= t2 * part.column("sq").to_numpy(zero_copy_only=False)[row]
                rows = pa.array(row[keep])
                yield pa.RecordBatch.from_arrays([*[part.column(c).take(rows) for c in [*scope, "v"]], pa.array(idx[keep], pa.int32())],
                                                 names=[*scope, "v", "bucket"])

    return verts.mapInArrow(run, schema)


def _packed_scores(pairs: DataFrame, scope: list[str], threshold: float) -> DataFrame:
    """``scope..., a, b, sim`` of pairs with both packed vectors; integers, so the sums are exact."""
    keys = [*scope, "a", "b"]
    schema = T.StructType([*[pairs.schema[c] for c in keys], T.StructField("sim", T.DoubleType())])

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for at in range(0, batch.num_rows, PACKED_ROWS):
                part = batch.slice(at, PACKED_ROWS)
                (ia, ra), (ib, rb) = _lists(part.column("ia")), _lists(part.column("ib"))
                if not len(ia) or not len(ib):
                    continue
                ca, cb = (_lists(part.column(c))[0].astype(np.int64) for c in ("ca", "cb"))
                dim = int(max(ia.max(), ib.max())) + 1
                ka, kb = ra * dim + ia, rb * dim + ib  # ascending: rows in order, buckets ascending in each
                to = np.minimum(np.searchsorted(kb, ka), len(kb) - 1)
                met = kb[to] == ka
                dot = np.bincount(ra[met], (ca[met] * cb[to[met]]).astype(np.float64), part.num_rows)
                sq = part.column("sa").to_numpy(zero_copy_only=False) * part.column("sb").to_numpy(zero_copy_only=False)
                with np.errstate(invalid="ignore", divide="ignore"):
                    sim = dot / np.sqrt(sq.astype(np.float64))
                rows = np.flatnonzero(sim >= float(threshold))
                yield pa.RecordBatch.from_arrays([*[part.column(c).take(pa.array(rows)) for c in keys], pa.array(sim[rows])], names=[*keys, "sim"])

    return pairs.select(*keys, "ia", "ca", "sa", "ib", "cb", "sb").mapInArrow(run, schema)


# --------------------------------------------------------------------- J2b

def _frame(cols: dict) -> pd.DataFrame:
    # an empty plain list becomes a column Arrow cannot convert; an empty object Series can
    return pd.DataFrame({c: (v if len(v) else pd.Series([], dtype=object)) for c, v in cols.items()})


def _block_job(scope: list[str], sparse: bool, mode: str, block_rows: int):

    def flat(lists, kind):
        """The values of all lists in one array, and where each list ends."""
        ends = np.cumsum([0, *map(len, lists)])
        return (np.concatenate(lists).astype(kind, copy=False) if ends[-1] else np.zeros(0, kind)), ends

    def stretch(values, ends, rows):
        """The lists of some rows (ascending) in one array, and their lengths."""
        size = ends[rows + 1] - ends[rows]
        if len(rows) and rows[-1] - rows[0] + 1 == len(rows):
            return values[ends[rows[0]]:ends[rows[-1] + 1]], size
        return np.concatenate([values[ends[r]:ends[r + 1]] for r in rows]) if len(rows) else values[:0], size

    def matrices(data, left, right):
        if sparse:
            # dense only over the buckets this block pair uses (column compression)
            idx, cnt, ends = data
            li, ln = stretch(idx, ends, left)
            ri, rn = (li, ln) if right is left else stretch(idx, ends, right)
            cols = np.unique(li if right is left else np.concatenate([li, ri]))

            def build(ix, size, rows):
                m = np.zeros((len(rows), len(cols)), dtype=np.float64)
                m[np.repeat(np.arange(len(rows)), size), np.searchsorted(cols, ix)] = stretch(cnt, ends, rows)[0]
                return m
            A = build(li, ln, left)
            return A, (A if right is left else build(ri, rn, right))
        lv = [data[i] for i in left]
        rv = lv if right is left else [data[i] for i in right]
        if len({len(v) for v in lv} | {len(v) for v in rv}) > 1:
            raise ValueError(LENGTH_ERROR)
        A = np.asarray([np.asarray(v, dtype=np.float64) for v in lv])
        return A, (A if right is left else np.asarray([np.asarray(v, dtype=np.float64) for v in rv]))

    def one_pair(skey, same, data, left, right, pos, t, whole, out: list):
        if mode != "max" and same and len(left) < 2:
            if not sparse:
                matrices(data, left, left)
            return
        A, B = matrices(data, left, right)
        qa = np.einsum("ij,ij->i", A, A)
        qb = qa if B is A else np.einsum("ij,ij->i", B, B)
        with np.errstate(invalid="ignore", divide="ignore"):
            if sparse:  # integers: dot and squared norms are exact, equal texts give 1.0
                S = (A @ B.T) / np.sqrt(np.outer(qa, qb))
            else:
                S = (A @ B.T) / np.outer(np.sqrt(qa), np.sqrt(qb))
        S[(qa == 0)[:, None] | (qb == 0)[None, :]] = 0.0
        pa, pb = pos[left], pos[right]
        if same:
            tri = pa[:, None] < pb[None, :]
        if mode == "max":
            vals = S[tri] if same else S.ravel()
            vals = vals[~np.isnan(vals)]
            if vals.size:
                out.append((skey, None, None, float(vals.max())))
            return
        with np.errstate(invalid="ignore"):
            keep = S >= t  # NaN compares False: never an edge
        if same:
            keep &= tri
        if not keep.any():
            return
        ii, jj = _led(keep, pa) if whole else np.nonzero(keep)
        a, b = pa[ii], pb[jj]
        out.append((skey, np.minimum(a, b), np.maximum(a, b), S[ii, jj], whole))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out: list = []
        if len(pdf):
            # rows of a block pair side by side, in the order they came; lists unpacked once for all
            part = pdf.groupby(scope + ["lo", "hi"], sort=False, dropna=False).ngroup().to_numpy()
            order = np.argsort(part, kind="stable")
            pdf, part = pdf.iloc[order], part[order]
            if sparse:
                idx, ends = flat(pdf["idx"].tolist(), np.int64)
                data = idx, flat(pdf["cnt"].tolist(), np.float64)[0], ends
            else:
                data = pdf["vec"].tolist()
            pos, blk, lo, hi = (pdf[c].to_numpy() for c in ("v", "blk", "lo", "hi"))
            keys = [pdf[c].tolist() for c in scope]
            if mode == "groups":
                whole = pdf["n"].to_numpy() <= block_rows
            else:
                whole = np.zeros(len(pdf), bool)
            t = pdf["t"].to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(part)) + 1), len(part)]
            for at, end in zip(cuts, cuts[1:]):
                rows = np.arange(at, end)
                same = lo[at] == hi[at]
                left = rows if same else rows[blk[at:end] == lo[at]]
                right = left if same else rows[blk[at:end] == hi[at]]
                if len(left) and len(right):
                    one_pair(tuple(k[at] for k in keys), same, data, left, right, pos, float(t[at]), bool(whole[at]), out)
        cols: dict = {c: [] for c in scope}
        if mode == "max":
            cols["max_sim"] = []
            for skey, _a, _b, m in out:
                for k, c in enumerate(scope):
                    cols[c].append(skey[k])
                cols["max_sim"].append(m)
            return _frame(cols)
        a_parts, b_parts, s_parts, flags = [], [], [], []
        for skey, a, b, sim, done in out:
            for k, c in enumerate(scope):
                cols[c].extend([skey[k]] * len(a))
            a_parts.append(a); b_parts.append(b); s_parts.append(sim); flags.append(np.full(len(a), done))
        res = _frame(cols)
        res["a"] = np.concatenate(a_parts) if a_parts else np.zeros(0, dtype=np.int64)
        res["b"] = np.concatenate(b_parts) if b_parts else np.zeros(0, dtype=np.int64)
        res["sim"] = np.concatenate(s_parts) if s_parts else np.zeros(0, dtype=np.float64)
        if mode == "groups":
            res["grouped"] = np.concatenate(flags) if flags else np.zeros(0, dtype=bool)
        return res

    return run


def _led(near: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(leader, member) rows of a whole scope from its similarity marks.

    By the set definition of the grouping: in position order a row that no
    leader has claimed leads, and claims the unclaimed rows it is marked with.
    """
    claimed = np.full(len(pos), -1)
    for i in np.argsort(pos, kind="stable"):
        if claimed[i] < 0:
            claimed[near[i] & (claimed < 0)] = i
    members = np.flatnonzero(claimed >= 0)
    return claimed[members], members


BROADCAST_SCOPES = 1 << 16  # scopes larger than a block whose sizes go to every task


def block_pairs(vertices: DataFrame, scope: list[str], threshold: float, pos: str = "pos",
                vector: str | None = "vector", block_rows: int = DEFAULT_BLOCK_ROWS, mode: str = "edges",
                threshold_col: str | None = None) -> DataFrame:
    """Exact edges by block-matrix multiplication.

    A scope of ``n`` rows is cut into ``ceil(n / block_rows)`` blocks by
    hashing ``pos``; every block pair ``lo <= hi`` of a large scope is its own
    group (about ``2 * block_rows`` vectors in memory, whatever the scope
    size). Scopes that fit in one block are packed by a hash of the scope
    into ``ceil(small_rows / block_rows)`` groups, so thousands of small
    documents cost a few Python calls, not one each. Inside a group, each
    scope is multiplied alone (numpy). With ``vector=None`` the sparse
    ``idx``/``cnt`` columns are densified over the buckets a block pair uses.
    ``mode="max"`` returns ``scope..., max_sim`` per scope instead (J3);
    ``mode="groups"`` adds ``grouped``: for scopes that fit in a block the
    rows are final (leader, member) pairs, for larger ones edges.
    ``threshold_col`` gives each scope its own threshold.
    """
    sparse = vector is None
    cols = ["idx", "cnt"] if sparse else [F.col(vector).alias("vec")]
    own = F.lit(float(threshold)) if threshold_col is None else F.col(threshold_col)
    v = vertices.select(*scope, F.col(pos).alias("v"), own.cast("double").alias("t"), *cols)
    if scope:
        sizes = vertices.groupBy(*scope).agg(F.count(F.lit(1)).alias("_n"))
        large = F.col("_n") > block_rows
        n_small, n_large = sizes.agg(F.coalesce(F.sum(F.when(~large, F.col("_n"))), F.lit(0)), F.count(F.when(large, 1))).first()
        if n_large <= BROADCAST_SCOPES:  # a scope that fits in a block need not know its size: no vector is shuffled for that
            v = v.where(" AND ".join(f"`{c}` IS NOT NULL" for c in scope))
            v = v.join(F.broadcast(sizes.where(large)), scope, "left") if n_large else v.withColumn("_n", F.lit(None).cast("bigint"))
            v = v.withColumn("_n", F.coalesce("_n", F.lit(1)))
        else:  # one row per scope; the join lets AQE split a hot scope (skew join)
            v = v.join(sizes, scope)
    else:
        total = v.count()  # one scalar for the single global scope
        v = v.withColumn("_n", F.lit(total))
    nblk = F.greatest(F.lit(1), F.ceil(F.col("_n") / F.lit(block_rows))).cast("int")
    v = v.withColumn("blk", F.pmod(F.xxhash64(F.col("v")), nblk.cast("bigint")).cast("int"))
    v = v.withColumn("_other", F.explode(F.sequence(F.lit(0), nblk - 1)))
    v = v.withColumn("lo", F.least("blk", "_other")).withColumn("hi", F.greatest("blk", "_other"))
    if scope:
        packs = max(1, math.ceil(n_small / block_rows))
        gkey = F.when(F.col("_n") <= block_rows, F.pmod(F.xxhash64(*scope), F.lit(packs))).otherwise(
            F.lit(packs) + F.pmod(F.xxhash64(*scope, "lo", "hi"), F.lit((1 << 62) - 1)))
    else:
        gkey = F.xxhash64("lo", "hi")
    v = v.withColumn("_g", gkey).withColumnRenamed("_n", "n").drop("_other")
    vt = v.schema["v"].dataType
    scope_fields = [vertices.schema[c] for c in scope]
    if mode == "max":
        schema = T.StructType(scope_fields + [T.StructField("max_sim", T.DoubleType())])
    else:
        schema = T.StructType(scope_fields + [
            T.StructField("a", vt), T.StructField("b", vt), T.StructField("sim", T.DoubleType())])
        if mode == "groups":
            schema = schema.add("grouped", T.BooleanType())
    job = _block_job(scope, sparse, mode, block_rows)
    out = v.groupBy("_g").applyInPandas(lambda pdf: job(pdf), schema)
    if mode == "max":
        return out.groupBy(*scope).agg(F.max("max_sim").alias("max_sim"))
    return out


def max_similarity(vertices: DataFrame, scope: list[str], pos: str = "pos", vector: str | None = "vector",
                   block_rows: int = DEFAULT_BLOCK_ROWS) -> DataFrame:
    """Highest similarity between two texts of each scope.

    Computed block by block; only one number per block pair leaves a task.
    """
    return block_pairs(vertices, scope, float("-inf"), pos, vector, block_rows, mode="max")


# --------------------------------------------------------------------- J4

POLYTOPES, CORNERS, PROBES = 2, 64, 3  # cross-polytopes of a table, their directions, nearest corners probed


def direction_signs(table: int, polytope: int, dim: int, seed: int, corners: int = CORNERS) -> np.ndarray:
    """``corners`` x ``dim`` of +1 / -1: parity of md5 of ``seed:table:polytope:corner:place``, the same everywhere."""
    import hashlib

    parity = [[int(hashlib.md5(f"{seed}:{table}:{polytope}:{c}:{i}".encode()).hexdigest()[0], 16) % 2 for i in range(dim)]
              for c in range(corners)]
    return 1.0 - 2.0 * np.array(parity)


def lsh_tables(threshold: float, recall: float = 0.95, polytopes: int = POLYTOPES, corners: int = CORNERS, probes: int = PROBES,
               max_tables: int = 512) -> int:
    """Tables that let a pair at the threshold meet with probability ``recall``.

    How often two such vectors share one of their nearest corners is measured on
    simulated directions (a fixed seed); a table needs that of all its polytopes.
    """
    rng = np.random.default_rng(11)
    t = max(-1.0, min(1.0, threshold))
    x = rng.standard_normal((20_000, corners))
    y = t * x + math.sqrt(1 - t * t) * rng.standard_normal((20_000, corners))
    marks = []
    for z in (x, y):
        near = np.argsort(-np.abs(z), axis=1)[:, :probes]
        mark = np.zeros((len(z), 2 * corners), bool)
        np.put_along_axis(mark, 2 * near + (np.take_along_axis(z, near, 1) > 0), True, axis=1)
        marks.append(mark)
    p = (marks[0] & marks[1]).any(axis=1).mean() ** polytopes
    if p >= 1:
        return 1
    tables = math.ceil(math.log(1 - recall) / math.log1p(-p)) if p > 0 else max_tables + 1
    if tables > max_tables:
        raise ValueError(f"threshold {threshold} needs {tables} tables; compare all pairs instead")
    return tables


def _nearest_corners(vectors: pd.Series, tables: int, seed: int, signs: dict):
    """``(dim, rows, corners)`` by dimension; corners: rows x tables x polytopes x probes. Zero and non-finite vectors are left out."""
    size = vectors.map(lambda x: 0 if x is None else len(x)).to_numpy()
    for dim in np.unique(size[size > 0]):
        rows = np.flatnonzero(size == dim)
        x = np.stack([np.asarray(v, float) for v in vectors.iloc[rows]])
        ok = np.isfinite(x).all(axis=1) & x.any(axis=1)
        if not ok.any():
            continue
        x = x[ok]
        corners = np.empty((len(x), tables, POLYTOPES, PROBES), np.uint8)
        for t in range(tables):
            for k in range(POLYTOPES):
                if (t, k, dim) not in signs:
                    signs[t, k, dim] = direction_signs(t, k, int(dim), seed)
                y = x @ signs[t, k, dim].T
                near = np.argsort(-np.abs(y), axis=1, kind="stable")[:, :PROBES]
                corners[:, t, k] = 2 * near + (np.take_along_axis(y, near, 1) > 0)
        yield int(dim), rows[ok], corners


def _table_codes(dim, corners: np.ndarray) -> np.ndarray:
    """Codes of one table from its corners (rows x polytopes x probes): a combination of corners each. ``dim``: one, or one a row."""
    codes = np.broadcast_to(np.asarray(dim, np.int64), len(corners))[:, None]
    for k in range(POLYTOPES):
        codes = (codes[:, :, None] * 2 * CORNERS + corners[:, k, None, :].astype(np.int64)).reshape(len(corners), PROBES ** (k + 1))
    return codes


def lsh_candidates(vertices: DataFrame, scope: list[str], threshold: float, pos: str = "pos", vector: str = "vector",
                   tables: int | None = None, seed: int = 7) -> DataFrame:
    """Pairs ``scope..., a, b`` (a < b) that meet in some table, each once."""
    tables = tables or lsh_tables(threshold)
    src = vertices.select(*scope, F.col(pos).alias("v"), as_double_vector(F.col(vector)).alias("vec"))
    fields = [src.schema[c] for c in scope] + [src.schema["v"]]
    schema = T.StructType(fields + [T.StructField("tbl", T.IntegerType()), T.StructField("side", T.LongType())])

    def sides(it):
        signs: dict = {}
        for pdf in it:
            for dim, ok, near in _nearest_corners(pdf["vec"], tables, seed, signs):
                keys = pdf.iloc[ok][[*scope, "v"]]
                for t in range(tables):
                    codes = _table_codes(dim, near[:, t])
                    yield keys.loc[keys.index.repeat(codes.shape[1])].assign(tbl=t, side=codes.ravel())

    met = src.mapInPandas(sides, schema)
    l, r = met.alias("l"), met.alias("r")
    on = [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in scope] + [
        F.col("l.tbl") == F.col("r.tbl"), F.col("l.side") == F.col("r.side"), F.col("l.v") < F.col("r.v")]
    return l.join(r, on).select(*[F.col(f"l.{c}").alias(c) for c in scope], F.col("l.v").alias("a"), F.col("r.v").alias("b")).distinct()


def lsh_pairs(vertices: DataFrame, scope: list[str], threshold: float, pos: str = "pos", vector: str = "vector",
              tables: int | None = None, seed: int = 7) -> DataFrame:
    """Approximate edges by cross-polytope hashing with multi-probe.

    A table turns a vector by two random sign matrices; it lies nearest to some corners of
    each cross-polytope and is filed under every pair of its three nearest of either. Vectors
    filed alike in some table are candidates, marked and verified block by block (no candidate is
    shuffled; a vector is copied once for each ``LSH_ROWS`` of its scope), so the
    result is a subset of the exact edges. ``tables`` come from the threshold
    (``lsh_tables``: expected recall 0.95 at the threshold, more above). Zero vectors and vectors with
    NaN have no corner and no edge.
    """
    tables = tables or lsh_tables(threshold)
    src = vertices.select(*scope, F.col(pos).alias("v"), as_double_vector(F.col(vector)).alias("vec")).dropna(subset=[*scope, "v", "vec"])
    keys = [src.schema[c] for c in scope]
    filed = T.StructType([*keys, src.schema["v"], src.schema["vec"], T.StructField("near", T.BinaryType())])

    def corners(it):
        signs: dict = {}
        for pdf in it:
            near = np.full(len(pdf), None, object)
            for _dim, rows, found in _nearest_corners(pdf["vec"], tables, seed, signs):
                near[rows] = [c.tobytes() for c in found]
            yield pdf.assign(near=near)

    v = src.mapInPandas(corners, filed)
    if scope:
        v = v.join(src.groupBy(*scope).agg(F.count(F.lit(1)).alias("_n")), scope)
    else:
        v = v.withColumn("_n", F.lit(src.count()))
    nblk = F.ceil(F.col("_n") / F.lit(LSH_ROWS)).cast("int")
    v = v.withColumn("blk", F.pmod(F.xxhash64("v"), nblk.cast("bigint")).cast("int")).withColumn("_o", F.explode(F.sequence(F.lit(0), nblk - 1)))
    v = v.withColumn("lo", F.least("blk", "_o")).withColumn("hi", F.greatest("blk", "_o")).drop("_o", "_n")
    kind = src.schema["v"].dataType
    schema = T.StructType([*keys, T.StructField("a", kind), T.StructField("b", kind), T.StructField("sim", T.DoubleType())])
    tile = LSH_TILE

    def meet(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        x = _Filed(pdf[pdf["blk"] == pdf["lo"]], tables, tile)
        y = x if key[-2] == key[-1] else _Filed(pdf[pdf["blk"] == pdf["hi"]], tables, tile)
        found = [f for p in range(0, len(x.ids), tile) for q in range(p if y is x else 0, len(y.ids), tile)
                 for f in _verified(x, p, y, q, threshold)]
        cols = [np.concatenate(c) for c in zip(*found)] if found else [[], [], []]
        out = pd.DataFrame(dict(zip(("a", "b", "sim"), cols)))
        for place, c in enumerate(scope):
            out[c] = key[place]
        return out[[*scope, "a", "b", "sim"]]

    return v.groupBy(*scope, "lo", "hi").applyInPandas(meet, schema)


LSH_ROWS, LSH_TILE = 4096, 1024  # rows of a block, ids of a tile


class _Filed:
    """A block of vectors with their corners, rows of one id side by side."""

    def __init__(self, pdf: pd.DataFrame, tables: int, tile: int):
        pdf = pdf.sort_values("v", kind="stable")
        self.pos, self.vec, self.tables, self.tile = pdf["v"].to_numpy(), pdf["vec"].tolist(), tables, tile
        self.ids, start = np.unique(self.pos, return_index=True)
        self.ends = np.append(start, len(self.pos))
        self.dims = np.array([len(x) for x in self.vec])
        self.near, self.sorted = pdf["near"].tolist(), {}

    def codes(self, p: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """By table: the codes of a tile of ids, ascending, and the id of each within the tile."""
        if p not in self.sorted:
            at = np.array([r for r in range(self.ends[p], self.ends[min(len(self.ids), p + self.tile)]) if self.near[r] is not None], np.int64)
            own = np.searchsorted(self.ends, at, "right") - 1 - p
            near = np.frombuffer(b"".join(self.near[r] for r in at), np.uint8).reshape(len(at), self.tables, POLYTOPES, PROBES)
            self.sorted[p] = []
            for t in range(self.tables):
                codes = _table_codes(self.dims[at], near[:, t])
                order = np.argsort(codes, axis=None, kind="stable")
                self.sorted[p].append((codes.ravel()[order], np.repeat(own, codes.shape[1])[order]))
        return self.sorted[p]


def _verified(x: _Filed, p: int, y: _Filed, q: int, threshold: float):
    """``(a, b, sim)`` of two tiles: ids that meet in some table are marked, their vectors compared."""
    tile = x.tile
    n, m = min(tile, len(x.ids) - p), min(tile, len(y.ids) - q)
    marked = np.zeros((n, m), bool)
    for (cx, ix), (cy, iy) in zip(x.codes(p), y.codes(q)):
        lo, hi = np.searchsorted(cy, cx), np.searchsorted(cy, cx, "right")
        size = hi - lo
        left = np.repeat(np.arange(len(cx)), size)
        right = np.arange(len(left)) + np.repeat(lo - (np.cumsum(size) - size), size)
        marked[ix[left], iy[right]] = True
    if x is y and p == q:
        marked = np.triu(marked, 1)
    for a in range(x.ends[p], x.ends[p + n], tile):
        rows = np.arange(a, min(a + tile, x.ends[p + n]))
        for c in range(y.ends[q], y.ends[q + m], tile):
            cols = np.arange(c, min(c + tile, y.ends[q + m]))
            some = marked[np.ix_(np.searchsorted(x.ends, rows, "right") - 1 - p, np.searchsorted(y.ends, cols, "right") - 1 - q)]
            for d in np.unique(x.dims[rows]):
                mine = x.dims[rows] == d
                alike = y.dims[cols] == d
                if some[np.ix_(mine, ~alike)].any():
                    raise ValueError(LENGTH_ERROR)
                r, k = rows[mine], cols[alike]
                if not len(k) or not d:
                    continue
                A, B = (np.stack([np.asarray(side.vec[i], float) for i in which]) for side, which in ((x, r), (y, k)))
                qa, qb = np.sqrt((A * A).sum(axis=1)), np.sqrt((B * B).sum(axis=1))
                with np.errstate(invalid="ignore", divide="ignore", over="ignore"):
                    sim = (A @ B.T) / np.outer(qa, qb)
                    sim[(qa == 0)[:, None] | (qb == 0)[None, :]] = 0.0
                    i, j = np.nonzero((sim >= threshold) & some[np.ix_(mine, alike)])
                one, two = x.pos[r[i]], y.pos[k[j]]
                first = one < two
                yield np.where(first, one, two), np.where(first, two, one), sim[i, j]
