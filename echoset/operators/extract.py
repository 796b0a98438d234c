"""Element extraction (X1-X7, P4) as a Spark job over a documents table.

Each document is parsed where it lies (``mapInArrow``, one streaming expat
pass per document, no DOM, rows handed on in small batches), so work spreads over all
partitions, no document travels to the driver and a worker holds a few documents. The parser is not namespace aware, like the
reference's factory defaults: an element's name is its qualified name.

Output of :func:`extract_elements` — one row per matching element, in
document order::

    doc_id, semid int, element string, text string

``semid`` is the 1-based position among *all* matches (X5), assigned at the
element's start tag, so nested matches are separate rows with the outer one
first (X4). ``text`` is the XPath string value (all descendant text, CDATA
included, comments and processing instructions excluded, entities decoded),
normalised by :func:`normalize_space` (X3); empty texts are dropped (P5), so
``semid`` may have gaps.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from echoset.functions.text import has_text, normalize_space
from echoset.sources.documents import DEFAULT_ELEMENTS

SEMID_ATTRIBUTE = "cms:semid"  # fixed value: attribute name written by the reference


def _parse_matches(xml: str, names: frozenset[str], with_meta: bool):
    """Stream one document through expat; return (matches, error).

    matches: list of (semid, name, raw_text, attributes, xpath, content) in
    start order; content is the element's markup as written (R11).
    """
    from xml.parsers import expat

    data = xml.encode("utf-8", "surrogatepass")
    parser = expat.ParserCreate("utf-8")  # no namespace separator: qualified names as written
    parser.buffer_text = True
    parts: list[str] = []  # text chunks since the outermost open match started
    stack: list[tuple] = []  # per open element: (semid or 0, name, start index in parts)
    open_matches = 0
    out: dict[int, tuple] = {}
    counter = [0]
    # for XPath positions: per depth, a dict name -> count of siblings seen
    sib: list[dict] = [{}]
    path: list[str] = []

    def start(name, attrs):
        nonlocal open_matches
        if with_meta:
            cnt = sib[-1].get(name, 0) + 1
            sib[-1][name] = cnt
            path.append(f"{name}[{cnt}]")
            sib.append({})
        if name in names:
            counter[0] += 1
            sid = counter[0]
            open_matches += 1
            meta = (dict(attrs), "/" + "/".join(path), parser.CurrentByteIndex) if with_meta else None
            stack.append((sid, name, len(parts), meta))
        else:
            stack.append((0, name, 0, None))

    def end(name):
        nonlocal open_matches
        sid, ename, begin, meta = stack.pop()
        if with_meta:
            path.pop()
            sib.pop()
        if sid:
            extra = (meta[0], meta[1], content(meta[2], name)) if with_meta else (None, None, None)
            out[sid] = (sid, ename, "".join(parts[begin:]), *extra)
            open_matches -= 1
            if open_matches == 0:
                parts.clear()

    def content(at, name):
        here = parser.CurrentByteIndex
        if not data.startswith(b"<" + name.encode(), at):
            return None  # inside an entity's replacement text: no markup of its own here
        if data.startswith(b"</", here):
            return data[at:data.index(b">", here) + 1].decode("utf-8", "surrogatepass")
        return data[at:data.index(b">", _START_TAG.match(data, at).end()) + 1].decode("utf-8", "surrogatepass")

    def chars(chunk):
        if open_matches:
            parts.append(chunk)

    parser.StartElementHandler = start
    parser.EndElementHandler = end
    parser.CharacterDataHandler = chars
    try:
        parser.Parse(data, True)
    except expat.ExpatError as exc:
        return [], f"malformed XML: {exc}"
    except (ValueError, RecursionError) as exc:  # e.g. entity expansion limits
        return [], f"unreadable XML: {exc}"
    return [out[k] for k in sorted(out)], None


SLICE_DOCS, SLICE_BYTES = 32, 4_000_000  # documents, and bytes of them, turned into Python objects at once
BATCH_ROWS, BATCH_CHARS = 4096, 2_000_000  # rows and characters handed on at once


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, list]]:
    """The rows of Arrow batches as lists by column, a few documents at a time.

    A batch holds up to ``maxRecordsPerBatch`` whole documents; only a slice of it becomes objects:
    ``SLICE_DOCS`` documents, fewer if they are long (a longer one than ``SLICE_BYTES`` may end a slice).
    """
    for batch in batches:
        size = pc.binary_length(batch.column("xml")).fill_null(0).to_numpy(zero_copy_only=False)
        cut = np.diff(np.cumsum(size, dtype=np.int64) // SLICE_BYTES) > 0
        cut |= np.arange(1, len(size)) % SLICE_DOCS == 0
        ends = [0, *(np.flatnonzero(cut) + 1).tolist(), len(size)]
        for at, end in zip(ends, ends[1:]):
            yield batch.slice(at, end - at).to_pydict()


def _extract_batches(names_default: str, with_meta: bool, schema: pa.Schema):
    def handed(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[str, frozenset[str]] = {}
        rows: list[tuple] = []
        chars = 0
        for part in slices(batches):
            for doc_id, xml, spec in zip(part["doc_id"], part["xml"], part.get("elements", [None] * SLICE_DOCS)):
                if spec is None:
                    spec = names_default
                names = cache.get(spec)
                if names is None:
                    names = cache[spec] = frozenset(n for n in spec.split() if n)
                if xml is None:
                    matches, err = [], "XML content not provided"
                else:
                    matches, err = _parse_matches(xml, names, with_meta)
                if err is not None or not matches:  # marker row: the document exists but nothing matched (X7)
                    matches = [(None,) * 6]
                for sid, name, text, attrs, xp, full in matches:
                    meta = (None if attrs is None else list(attrs.items()), xp, full) if with_meta else ()
                    rows.append((doc_id, sid, name, text, err, *meta))
                    chars += len(text or "") + len(err or "")
                    if with_meta:
                        chars += len(xp or "") + len(full or "") + sum(map(len, (attrs or {}).values()))
                    if len(rows) >= BATCH_ROWS or chars >= BATCH_CHARS:
                        yield handed(rows)
                        rows, chars = [], 0
        if rows:
            yield handed(rows)
    return run


def parse_documents(docs: DataFrame, elements: str = DEFAULT_ELEMENTS, with_meta: bool = False) -> DataFrame:
    """Raw parse output: element rows plus one ``parse_error`` row per bad document.

    ``docs`` needs ``doc_id`` and ``xml``; an optional ``elements`` column
    overrides the element list per row.
    """
    cols = ["doc_id", "xml"] + (["elements"] if "elements" in docs.columns else [])
    fields = [
        T.StructField("doc_id", docs.schema["doc_id"].dataType),
        T.StructField("semid", T.IntegerType()),
        T.StructField("element", T.StringType()),
        T.StructField("raw_text", T.StringType()),
        T.StructField("parse_error", T.StringType()),
    ]
    if with_meta:
        fields += [
            T.StructField("attributes", T.MapType(T.StringType(), T.StringType())),
            T.StructField("xpath", T.StringType()),
            T.StructField("content", T.StringType()),
        ]
    schema = T.StructType(fields)
    return docs.select(*cols).mapInArrow(_extract_batches(elements, with_meta, to_arrow_schema(schema)), schema)


def extract_elements(docs: DataFrame, elements: str = DEFAULT_ELEMENTS, with_meta: bool = False) -> DataFrame:
    """X1-X5 + P5: matching elements with normalised, non-empty text."""
    parsed = parse_documents(docs, elements, with_meta)
    extra = ["attributes", "xpath", "content"] if with_meta else []
    return (
        # asked of the raw text: a filter on the normalised one would be pushed down and normalise twice
        parsed.where(F.col("parse_error").isNull() & F.col("semid").isNotNull() & has_text("raw_text"))
        .select("doc_id", "semid", "element", normalize_space("raw_text").alias("text"), *extra)
    )


def parse_errors(docs: DataFrame, elements: str = DEFAULT_ELEMENTS) -> DataFrame:
    """``(doc_id, error)`` for every document that is not well-formed XML."""
    return parse_documents(docs, elements).where(F.col("parse_error").isNotNull()).select(
        "doc_id", F.col("parse_error").alias("error"))


# ---------------------------------------------------------------- X6 / R13

_START_TAG = re.compile(rb"""<[^\s/>]+(?:\s+[^\s=/>]+\s*=\s*(?:"[^"]*"|'[^']*'))*""")
_OLD_ATTRIBUTE = re.compile(rb"""\s+""" + SEMID_ATTRIBUTE.encode() + rb"""\s*=\s*(?:"[^"]*"|'[^']*')""")


def _annotate_one(xml: str, names: frozenset[str]):
    """The document as it stands, with the attribute written into matching start tags.

    One streaming pass notes where the tags begin; everything else, prolog,
    comments and entities included, is copied unchanged at any depth.
    """
    from xml.parsers import expat

    data = xml.encode("utf-8", "surrogatepass")
    parser = expat.ParserCreate("utf-8")
    found: list[tuple[int, bytes]] = []

    def start(name, _attrs):
        if name in names:
            found.append((parser.CurrentByteIndex, name.encode()))

    parser.StartElementHandler = start
    try:
        parser.Parse(data, True)
    except (expat.ExpatError, ValueError) as exc:
        return None, f"malformed XML: {exc}"
    out, done = [], 0
    for n, (at, name) in enumerate(found, 1):
        if not data.startswith(b"<" + name, at) or at < done:
            continue  # an element inside an entity's replacement text has no tag here
        tag = _START_TAG.match(data, at)
        after = at + 1 + len(name)
        out += [data[done:after], f' {SEMID_ATTRIBUTE}="{n}"'.encode(), _OLD_ATTRIBUTE.sub(b"", data[after:tag.end()])]
        done = tag.end()
    return b"".join([*out, data[done:]]).decode("utf-8", "surrogatepass"), None


def annotate_documents(docs: DataFrame, elements: str = DEFAULT_ELEMENTS) -> DataFrame:
    """The document with ``cms:semid`` set on every match (1, 2, ... in order).

    Returns ``(doc_id, annotated_xml, error)``; an existing attribute of that
    name is overwritten; malformed documents get ``error`` and a null copy.
    """
    names_default = elements

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out_xml, out_err = [], []
            for i, xml in enumerate(pdf["xml"]):
                spec = pdf["elements"].iat[i] if "elements" in pdf.columns else None
                names = frozenset((spec if isinstance(spec, str) else names_default).split())
                if xml is None:
                    a, e = None, "XML content not provided"
                else:
                    a, e = _annotate_one(xml, names)
                out_xml.append(a)
                out_err.append(e)
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "annotated_xml": out_xml, "error": out_err})

    cols = ["doc_id", "xml"] + (["elements"] if "elements" in docs.columns else [])
    schema = T.StructType([
        T.StructField("doc_id", docs.schema["doc_id"].dataType),
        T.StructField("annotated_xml", T.StringType()),
        T.StructField("error", T.StringType()),
    ])
    return docs.select(*cols).mapInPandas(run, schema)
