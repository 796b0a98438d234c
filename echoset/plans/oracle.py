"""DuckDB SQL that recomputes each registered query from the raw tables.

Independent of the Spark plans on purpose: no duplicate collapsing, no prefix
filter, no blocks. Grouping is the reference's sequential walk written as a
recursive CTE: step k looks at the k-th text of its scope and appends it to
the leader list unless one of its earlier neighbours already leads.
"""

from __future__ import annotations

NL = "chr(10)"


def lines_items(table: str = "documents") -> str:
    """Every line of ``text`` as an element (X1-X5 + P5 for wrapped lines)."""
    return rf"""
raw_lines AS (
  SELECT doc_id, unnest(string_split(text, {NL})) AS line,
         unnest(range(1, len(string_split(text, {NL})) + 1)) AS semid
  FROM {table}
),
items AS (
  SELECT doc_id, CAST(semid AS INTEGER) AS semid,
         trim(regexp_replace(line, '[ \t\r\n]+', ' ', 'g')) AS text
  FROM raw_lines
  WHERE trim(regexp_replace(line, '[ \t\r\n]+', ' ', 'g')) <> ''
)"""


def _on(scope: list[str], x: str, y: str) -> str:
    return " AND ".join([f"{x}.{c} = {y}.{c}" for c in scope] or ["TRUE"])


def hashed(scope: list[str], order: str, dim: int, src: str = "items") -> str:
    """``wf(scope..., pos, bucket, w)``: hashing encoder per item."""
    s = ", ".join(scope)
    return rf"""
words AS (
  SELECT {s}, {order} AS pos, unnest(string_split_regex(text, '\s+')) AS word FROM {src}
),
feats AS (
  SELECT {s}, pos, CAST(('0x' || substr(md5(lower(word)), 1, 8))::BIGINT % {dim} AS INTEGER) AS bucket,
         count(*) AS c
  FROM words WHERE word <> '' GROUP BY ALL
),
wf AS (
  SELECT {s}, pos, bucket, c, sum(c * c) OVER (PARTITION BY {s}, pos)::BIGINT AS sq,
         c / sqrt(sum(c * c) OVER (PARTITION BY {s}, pos)) AS w FROM feats
)"""


def sparse_edges(scope: list[str], threshold: float) -> str:
    s = ", ".join(f"x.{c}" for c in scope)
    return f"""
edges AS (
  SELECT * FROM (
    SELECT {s}, x.pos AS a, y.pos AS b, sum(x.c * y.c) / sqrt((any_value(x.sq) * any_value(y.sq))::DOUBLE) AS sim
    FROM wf x JOIN wf y ON {_on(scope, 'x', 'y')} AND x.bucket = y.bucket AND x.pos < y.pos
    GROUP BY ALL) WHERE sim >= {threshold}
)"""


def dense_edges(scope: list[str], order: str, vector: str, threshold: float, src: str) -> str:
    s = ", ".join(f"x.{c}" for c in scope)
    return f"""
vecs AS (SELECT {", ".join(scope)}, {order} AS pos, CAST({vector} AS DOUBLE[]) AS v FROM {src}),
edges AS (
  SELECT {s}, x.pos AS a, y.pos AS b, list_cosine_similarity(x.v, y.v) AS sim
  FROM vecs x JOIN vecs y ON {_on(scope, 'x', 'y')} AND x.pos < y.pos
  WHERE list_cosine_similarity(x.v, y.v) >= {threshold}
)"""


def greedy(scope: list[str]) -> str:
    """``final_leaders(scope..., leader)`` and ``assign(scope..., member, leader, sim)``."""
    s = ", ".join(scope)
    vs = ", ".join(f"v.{c}" for c in scope)
    ws = ", ".join(f"w.{c}" for c in scope)
    es = ", ".join(f"e.{c}" for c in scope)
    return f"""
vlist AS (
  SELECT {s}, pos, row_number() OVER (PARTITION BY {s} ORDER BY pos) AS k
  FROM (SELECT {s}, a AS pos FROM edges UNION SELECT {s}, b AS pos FROM edges)
),
nbr AS (SELECT {s}, b AS pos, list(a) AS earlier FROM edges GROUP BY ALL),
steps AS (
  SELECT {vs}, v.k, v.pos, coalesce(n.earlier, []) AS earlier
  FROM vlist v LEFT JOIN nbr n ON {_on(scope, 'v', 'n')} AND v.pos = n.pos
),
walk AS (
  SELECT {s}, 0 AS k, CAST([] AS BIGINT[]) AS leaders FROM (SELECT DISTINCT {s} FROM steps)
  UNION ALL
  SELECT {ws}, w.k + 1,
         CASE WHEN list_has_any(st.earlier, w.leaders) THEN w.leaders
              ELSE list_append(w.leaders, CAST(st.pos AS BIGINT)) END
  FROM walk w JOIN steps st ON {_on(scope, 'st', 'w')} AND st.k = w.k + 1
),
final_leaders AS (
  SELECT {s}, unnest(leaders) AS leader FROM (SELECT {s}, arg_max(leaders, k) AS leaders FROM walk GROUP BY ALL)
),
assign AS (
  SELECT {es}, e.b AS member, min(e.a) AS leader, arg_min(e.sim, e.a) AS sim
  FROM edges e JOIN final_leaders l ON {_on(scope, 'e', 'l')} AND e.a = l.leader
  GROUP BY ALL
)"""


def members_cte(scope: list[str], order: str, with_text: bool = True, src: str = "items",
                extra: tuple[str, ...] = ()) -> str:
    """``members`` CTE in the engine's output shape (``sim`` unrounded)."""
    i_s = ", ".join(f"i.{c}" for c in scope)
    text = ", i.text" if with_text else ""
    more = "".join(f", i.{c}" for c in extra)
    return f"""
roles AS (
  SELECT {", ".join(scope)}, member AS pos, leader, sim FROM assign
  UNION ALL
  SELECT DISTINCT {", ".join(scope)}, leader AS pos, leader, CAST(NULL AS DOUBLE) AS sim FROM assign
),
members AS (
  SELECT {i_s}, r.leader AS leader_{order}, i.{order}, (r.leader = r.pos) AS is_leader,
         r.sim AS sim{text}{more}
  FROM {src} i JOIN roles r ON {_on(scope, 'i', 'r')} AND i.{order} = r.pos
)"""


def with_clause(*parts: str) -> str:
    return "WITH RECURSIVE " + ",".join(p.strip("\n") for p in parts)
