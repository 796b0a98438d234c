"""Secret scans with multipart credential linking.

One pass over each text finds the spans of every kind where the text lies:

* strong kinds, reported always: ``assign`` (a name such as password or
  api_key and its value), ``access`` (access identifiers) and ``hex`` (long
  hexadecimal strings);
* weak candidates, each the part of a credential that says little alone:
  ``endpoint`` (a URL or host name of a service), ``account`` (a user name or
  client id with a value) and ``opaque`` (a long mixed-case string with digits).

Parts are linked in Spark: an interval join brings together, within one text,
parts whose distance is at most ``reach`` code points. Both sides are binned by
``reach``, so a part meets only the parts of its own and the next bins. A weak
candidate is reported only if a complementary part lies in its scope: an
identifier or endpoint needs a secret, a secret an identifier or endpoint.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, picked

# Fixed by the contract: patterns and least lengths of the strong kinds, in this order.
ASSIGN = re.compile(
    r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])"""
    r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # runs are maximal, so this is the run of 24 or more
LEAST_VALUE, LEAST_ACCESS = 6, 20

# The method's own weak candidates.
ENDPOINT = re.compile(r"\b(?:https?|wss?|jdbc:[a-z]+|postgres|mysql|mongodb|redis|amqps?)://[A-Za-z0-9._:@/?&=%+-]+")
ACCOUNT = re.compile(r"""\b(?:[uU]ser(?:name)?|[lL]ogin|[cC]lient_?[iI]d|[aA]ccount)["']?\x20*[:=]\x20*["']?([A-Za-z0-9._@-]{3,})""")
OPAQUE = re.compile(r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z0-9+/_-]*[0-9])(?=[A-Za-z0-9+/_-]*[A-Z])(?=[A-Za-z0-9+/_-]*[a-z])[A-Za-z0-9+/_-]{32,}")

# kind: (order among spans of one start, role, reported alone)
KINDS = {
    "assign": (0, "secret", True), "access": (1, "identifier", True), "hex": (2, "secret", True),
    "account": (3, "identifier", False), "endpoint": (4, "endpoint", False), "opaque": (5, "secret", False),
}
NAMES = ("pass", "secret", "token", "api")


def find_spans(text: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, end) of all parts in a text, in code points, end exclusive."""
    if not text:
        return []
    out = []
    if any(c in text for c in ":="):
        low = text.lower()
        if any(n in low for n in NAMES):
            out += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= LEAST_VALUE]
        if "user" in low or "login" in low or "client" in low or "account" in low:
            out += [("account", m.start(), m.end()) for m in ACCOUNT.finditer(text)]
        if "://" in text:
            out += [("endpoint", m.start(), m.end()) for m in ENDPOINT.finditer(text)]
    if "AKIA" in text:
        out += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    out += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    if out:  # an opaque string says nothing without another part
        out += [("opaque", m.start(), m.end()) for m in OPAQUE.finditer(text)]
    return sorted(out, key=lambda x: (x[1], KINDS[x[0]][0], x[2]))


def secret_spans(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id``, ``row`` and arrays ``kind``, ``start``, ``end``; one row per row of ``docs``, checkpointed."""
    src = picked(docs, id=id_col, text=text_col)
    id_type = src.schema["id"].dataType.simpleString()

    def run(it):
        for pdf in it:
            found = [find_spans(t) for t in pdf["text"]]
            yield pd.DataFrame({
                "id": pdf["id"],
                "kind": [[x[0] for x in f] for f in found],
                "start": [[x[1] for x in f] for f in found],
                "end": [[x[2] for x in f] for f in found],
            })

    schema = f"id {id_type}, kind array<string>, start array<bigint>, end array<bigint>"
    return cut(src.mapInPandas(run, schema).withColumn("row", F.monotonically_increasing_id()))


def link_parts(parts: DataFrame, reach: int) -> DataFrame:
    """The weak parts with a complementary part within ``reach`` code points, once each.

    ``parts`` has ``row, kind, start, end, role, strong``. Interval join on
    bins of width ``reach``: a part lies in the bins it touches, widened by one
    to each side for the weak ones, so two parts within reach share a bin.
    Each bin first shrinks to the extremes of a role (least start, greatest
    end). A weak part's scope is wider than a bin, so in any bin it reaches one
    side at most is open and the extremes decide exactly: a bin of many
    parts never yields all pairs.
    """
    touched = lambda lo, hi: F.explode(F.sequence(F.floor(lo / reach), F.floor(hi / reach)))
    other = parts.select("row", "role", "start", "end", touched(F.col("start"), F.col("end")).alias("bin"))
    edges = other.groupBy("row", "bin", "role").agg(
        F.min("start").alias("first"), F.max("end").alias("last"))
    weak = parts.where("NOT strong").select(
        "row", "kind", "start", "end", F.col("role").alias("own"),
        touched(F.greatest(F.lit(0), F.col("start") - reach), F.col("end") + reach).alias("bin"))
    near = (F.col("first") <= F.col("end") + reach) & (F.col("last") >= F.col("start") - reach)
    # a credential needs its secret: identifiers and endpoints complete a secret, not each other
    complementary = (F.col("role") == "secret") != (F.col("own") == "secret")
    return (
        weak.join(edges, ["row", "bin"]).where(complementary & near)
        .select("row", "kind", "start", "end").distinct()
    )


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", reach: int = 200) -> DataFrame:
    """``<id_col>`` and ``spans``: array of ``(kind, start, end)`` by start, one row per row of ``docs``.

    Null and empty texts have no span. Weak candidates are there only with a
    complementary part within ``reach`` code points. Whole texts are scanned.
    """
    rows = secret_spans(docs, id_col, text_col)
    roles = F.create_map(*[F.lit(x) for k, v in KINDS.items() for x in (k, v[1])])
    orders = F.create_map(*[F.lit(x) for k, v in KINDS.items() for x in (k, v[0])])
    strong = F.array(*[F.lit(k) for k, v in KINDS.items() if v[2]])
    parts = rows.where(F.size("kind") > 1).select("row", F.inline(F.arrays_zip("kind", "start", "end"))).select(
        "row", "kind", "start", "end", roles[F.col("kind")].alias("role"), F.array_contains(strong, F.col("kind")).alias("strong"))
    linked = link_parts(parts, reach).groupBy("row").agg(F.collect_list(F.struct("kind", "start", "end")).alias("linked"))
    zipped = F.arrays_zip("kind", "start", "end")
    alone = F.filter(zipped, lambda s: F.array_contains(strong, s["kind"]))
    every = F.concat(alone, F.coalesce("linked", F.filter(zipped, lambda s: F.lit(False))))
    ordered = F.transform(
        F.array_sort(F.transform(every, lambda s: F.struct(
            s["start"].alias("start"), orders[s["kind"]].alias("order"), s["end"].alias("end"), s["kind"].alias("kind")))),
        lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    return rows.join(linked, "row", "left").select(F.col("id").alias(id_col), ordered.alias("spans"))


def spans_text(spans) -> F.Column:
    """Spans as ``kind:start:end``, comma-joined."""
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])))


def secret_digest(scanned: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts of the strong kinds, sha256 of their spans, and all spans as text."""
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    strong = F.filter("spans", lambda s: s["kind"].isin("assign", "access", "hex"))
    return scanned.select(
        id_col, count("assign"), count("access"), count("hex"),
        F.sha2(spans_text(strong), 256).alias("base_sha256"), spans_text(F.col("spans")).alias("spans"))
