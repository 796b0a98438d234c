"""Documents as interval-encoded nodes, and element lists as structural range joins.

:func:`node_table` parses each document once: a row per element and per run
of text, numbered by where it starts, elements with the number that follows their
last descendant. A node lies inside an element exactly if its start lies between the element's
start and end, at any depth. Any number of element lists can then be asked of the same
documents without parsing them again: :func:`select_elements` is a join on (document, name) for the
matches and a range join for their text, all in Spark SQL.

The range join is an equi-join on (document, stretch of ``STRETCH`` numbers): a text node lies in
one stretch, an element is repeated for each stretch that it reaches over, so a long flat document
does not compare every element with every text.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from echoset.functions.text import normalize_space
from echoset.operators.extract import BATCH_CHARS, slices

STRETCH = 256  # node numbers in a stretch
BATCH_NODES = 4096  # rows handed on at once


def _nodes_of(xml: str):
    """(kind, start, end, level, name, path, attributes, text) of a document's nodes, or its error."""
    from xml.parsers import expat

    parser = expat.ParserCreate("utf-8")  # names as written, like the element job
    parser.buffer_text = True
    out: list[list] = []
    open_: list[tuple[int, dict, str]] = [(-1, {}, "")]  # place in out, children seen by name, path
    number = 0

    def start(name, attrs):
        nonlocal number
        _, seen, path = open_[-1]
        seen[name] = seen.get(name, 0) + 1
        path = f"{path}/{name}[{seen[name]}]"
        out.append(["element", number, None, len(open_), name, path, dict(attrs), None])
        open_.append((len(out) - 1, {}, path))
        number += 1

    def end(_name):
        out[open_.pop()[0]][2] = number

    def chars(text):
        nonlocal number
        out.append(["text", number, number + 1, len(open_), None, None, None, text])
        number += 1

    parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler = start, end, chars
    try:
        parser.Parse(xml.encode("utf-8", "surrogatepass"), True)
    except expat.ExpatError as exc:
        return [], f"malformed XML: {exc}"
    except (ValueError, RecursionError) as exc:
        return [], f"unreadable XML: {exc}"
    return out, None


def _node_batches(schema: pa.Schema):
    def handed(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        chars = 0
        for part in slices(batches):
            for doc_id, xml in zip(part["doc_id"], part["xml"]):
                nodes, error = ([], "XML content not provided") if xml is None else _nodes_of(xml)
                if error is not None:
                    nodes = [("error", None, None, None, None, None, None, error)]
                for *n, path, attributes, text in nodes:
                    rows.append((doc_id, *n, path, attributes if attributes is None else list(attributes.items()), text))
                    chars += len(path or "") + len(text or "") + sum(map(len, (attributes or {}).values()))
                    if len(rows) >= BATCH_NODES or chars >= BATCH_CHARS:
                        yield handed(rows)
                        rows, chars = [], 0
        if rows:
            yield handed(rows)

    return run


def node_table(docs: DataFrame) -> DataFrame:
    """``doc_id, kind, start, end, level, name, path, attributes, text`` of all documents (``doc_id``, ``xml``).

    ``kind`` is ``element``, ``text`` or, for a document that cannot be read (one row, the cause in
    ``text``), ``error``. ``level`` is 1 for the root. Comments and processing instructions are no nodes.
    """
    id_field = T.StructField("doc_id", docs.schema["doc_id"].dataType)
    schema = T.StructType([id_field, *T.StructType.fromDDL(
        "kind string, start long, end long, level int, name string, path string, attributes map<string,string>, text string").fields])
    return docs.select("doc_id", "xml").mapInArrow(_node_batches(to_arrow_schema(schema)), schema)


def select_elements(nodes: DataFrame, requests: DataFrame) -> DataFrame:
    """Elements of each request: ``request_id, doc_id, semid, element, text, path, attributes, level``.

    ``requests`` hold ``request_id, doc_id, elements`` (names parted by white space; repeats do
    nothing). ``semid`` numbers all matches of a request in document order, nested ones after the element
    they lie in; elements without text are dropped after numbering.
    """
    asked = requests.select("request_id", "doc_id", F.explode(F.array_distinct(F.split(F.trim("elements"), r"\s+"))).alias("name"))
    hits = nodes.where("kind = 'element'").drop("kind", "text").join(asked, ["doc_id", "name"])
    numbered = hits.withColumn("semid", F.row_number().over(Window.partitionBy("request_id", "doc_id").orderBy("start")))
    stretch = lambda c: F.floor(F.col(c) / STRETCH)
    reach = numbered.select(
        "request_id", "doc_id", "semid", "start", "end",
        F.explode(F.sequence(stretch("start"), F.floor((F.col("end") - 1) / STRETCH))).alias("stretch"))
    texts = nodes.where("kind = 'text'").select("doc_id", F.col("start").alias("at"), stretch("start").alias("stretch"), "text")
    inside = reach.join(texts, ["doc_id", "stretch"]).where("at > start AND at < end")
    joined = inside.groupBy("request_id", "doc_id", "semid").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "text"))), lambda x: x["text"]), "").alias("raw"))
    return (
        numbered.join(joined, ["request_id", "doc_id", "semid"])
        .select("request_id", "doc_id", F.col("semid").cast("int").alias("semid"), F.col("name").alias("element"),
                normalize_space("raw").alias("text"), "path", "attributes", "level")
        .where(F.col("text") != ""))


def unreadable(nodes: DataFrame) -> DataFrame:
    """``doc_id, error`` of the documents that could not be read."""
    return nodes.where("kind = 'error'").select("doc_id", F.col("text").alias("error"))
