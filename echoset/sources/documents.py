"""Sources (S1, S2): XML documents and the vocabulary.

Every reader returns a lazy DataFrame; nothing passes through the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from echoset.functions.text import xml_escape

# Fixed values of the reference: default element list and default threshold.
DEFAULT_ELEMENTS = "p"
DEFAULT_THRESHOLD = 0.75


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One driver table (parquet) from a scale-factor folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_xml_files(spark: SparkSession, path: str) -> DataFrame:
    """One row per file, ``doc_id`` = file path, ``xml`` = whole content.

    Where ``path`` names folders, the tasks list and read them: the driver knows the folders only, not their files
    (Spark's own reader keeps an entry for every file there, and the plan of the scan another). Files named directly, and stores
    that only Spark reads, go through Spark's reader: ``wholetext`` keeps each file in one row, the path comes from the
    hidden ``_metadata`` column. Spark counts a small file as 4 MB and gives a task 32 of them; tasks of many files
    take up to 8 such shares.
    """
    enough = 8 * spark.sparkContext.defaultParallelism
    folders = _folders(spark, path)
    if folders:
        n = min(len(folders), enough)
        return spark.range(0, n, 1, n).mapInArrow(_folder_reader(folders, n), "doc_id string, xml string")
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("doc_id"), F.col("value").alias("xml"))
    parts = files.rdd.getNumPartitions()
    return files.coalesce(max(enough, parts // 8)) if parts > enough else files


def _folders(spark: SparkSession, path: str) -> list[tuple[str, str]]:
    """The folders that ``path`` names, as (path, path as Spark spells it); none if it names anything else or tasks can't open them."""
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    found = list(at.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(at) or [])
    if not all(f.isDirectory() for f in found):
        return []
    out = [(f.getPath().toString(), jvm.org.apache.spark.paths.SparkPath.fromFileStatus(f).urlEncoded()) for f in found]
    try:
        for folder, _ in out[:1]:
            open_folder(folder)
    except (OSError, ValueError, NotImplementedError):
        return []
    return out


READ_FILES, READ_BYTES = 1024, 4_000_000  # files, and bytes of them, handed on at once


def _folder_reader(folders: list[tuple[str, str]], n: int):
    """Reads every ``n``-th folder's files; what Spark's reader leaves out (hidden and empty files, folders but ``key=value``) is left out."""
    def run(batches):
        import re

        import pyarrow as pa
        from pyarrow.fs import FileSelector, FileType

        names, texts, size = [], [], 0

        def handed():
            return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(texts, pa.binary()).cast(pa.string(), safe=False)],
                                              names=["doc_id", "xml"])

        def files(fs, root, spelled):
            for f in fs.get_file_info(FileSelector(root)):
                name = f.base_name
                if name.startswith(".") or name.endswith("._COPYING_") or name.startswith("_") and "=" not in name:
                    continue
                own = re.sub(r"[\x00-\x7f]", lambda c: c[0] if re.match(r"[\w\-!.~'()*@&=+$,;:]", c[0]) else f"%{ord(c[0]):02X}", name)
                if f.type == FileType.Directory:
                    if "=" in name:
                        yield from files(fs, f.path, f"{spelled}/{own}")
                elif f.size != 0:
                    yield f.path, f"{spelled}/{own}"

        for k in (k for batch in batches for k in batch.column(0).to_pylist()):
            for folder, spelled in folders[k::n]:
                fs, root = open_folder(folder)
                for at, name in files(fs, root, spelled):
                    with fs.open_input_stream(at) as f:
                        texts.append(f.read())
                    names.append(name)
                    size += len(texts[-1])
                    if len(names) >= READ_FILES or size >= READ_BYTES:
                        yield handed()
                        names, texts, size = [], [], 0
        if names:
            yield handed()

    return run


FILE_FOLDERS = 256  # folders that document files are dealt over
NO_ID = "__HIVE_DEFAULT_PARTITION__"  # the name Spark gives a null


def open_folder(folder: str):
    """(pyarrow file system, path) of a folder any node can reach."""
    from pyarrow import fs

    if folder.startswith("file:"):
        folder = "/" + folder[len("file:"):].lstrip("/")
    if folder.startswith("/"):
        return fs.LocalFileSystem(), folder
    return fs.FileSystem.from_uri(folder)


def write_document_files(documents: DataFrame, folder: str) -> int:
    """S1, the other way: every document (``doc_id, xml``) as a file ``<folder>/<n>/doc_id=<doc_id>.<task>.xml``; returns the files.

    Each task writes its own rows straight into the shared folder, under a name of its own first, so a repeated or
    parallel attempt replaces a whole file by an equal one. Rows of a task with one id share a file, a line each.
    """
    def write(batches):
        import zlib
        from itertools import groupby

        import pyarrow as pa
        from pyspark import TaskContext

        context = TaskContext.get()
        task, own = context.partitionId(), context.taskAttemptId()
        fs, root = open_folder(folder)
        made: set[int] = set()
        n = 0

        def rows():
            for batch in batches:
                yield from zip(*(batch.column(c) for c in ("doc_id", "xml")))

        for doc_id, same in groupby(((i.as_py(), x) for i, x in rows()), key=lambda r: r[0]):
            name = NO_ID if doc_id is None else str(doc_id)
            place = zlib.crc32(name.encode()) % FILE_FOLDERS
            if place not in made:
                fs.create_dir(f"{root}/{place}", recursive=True)
                made.add(place)
            with fs.open_output_stream(f"{root}/{place}/_{own}") as f:
                for _, xml in same:
                    f.write((xml.as_buffer().to_pybytes() if xml.is_valid else b"") + b"\n")
            fs.move(f"{root}/{place}/_{own}", f"{root}/{place}/doc_id={name}.{task}.xml")
            n += 1
        yield pa.RecordBatch.from_pydict({"n": [n]})

    files = documents.select("doc_id", "xml").sortWithinPartitions("doc_id").mapInArrow(write, "n bigint")
    return files.agg(F.sum("n")).first()[0] or 0


def lines_as_xml(documents: DataFrame, text_col: str = "text", id_col: str = "doc_id",
                 root: str = "doc", element: str = "p") -> DataFrame:
    """Wrap every line of a plain-text column as an ``<element>`` of one XML document.

    Row-local string expressions only: escape the five special characters,
    turn each line break into a close/open tag pair. Returns ``(doc_id, xml)``.
    """
    body = F.replace(xml_escape(F.col(text_col)), F.lit("\n"), F.lit(f"</{element}><{element}>"))
    xml = F.concat(F.lit(f"<{root}><{element}>"), body, F.lit(f"</{element}></{root}>"))
    return documents.select(F.col(id_col).alias("doc_id"), xml.alias("xml"))


def read_vocab(spark: SparkSession, path: str) -> DataFrame:
    """Vocabulary file, one token per line, the 0-based line number is the id.

    The file is read whole so line numbers are exact; the empty piece after a
    final newline is dropped; a repeated token keeps its last id.
    """
    pieces = F.split(F.col("value"), "\r\n|\r|\n")  # line ends as a line reader sees them
    lines = (
        spark.read.text(path, wholetext=True)
        .select(F.posexplode(pieces).alias("id", "token"), F.size(pieces).alias("n"))
        .where(~((F.col("id") == F.col("n") - 1) & (F.col("token") == "")))
    )
    return lines.groupBy("token").agg(F.max("id").cast("int").alias("id"))
