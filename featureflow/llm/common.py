"""Helpers shared by the operators: shipping the package to executors, text
batches, scratch tables and files in the cluster's shared folder."""

from __future__ import annotations

import hashlib
import os
import re
import tempfile
import uuid
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_dir, scratch_dir

#: Text that a task holds decoded at once, in characters.
BATCH_CHARS = 1 << 20


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in Python workers that do not have it on
    their path (once per context; a zip of the sources, like ``--py-files``)."""
    sc = spark.sparkContext
    if getattr(sc, "_featureflow_shipped", False):
        return
    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    files = sorted(
        os.path.join(folder, name)
        for folder, _, names in os.walk(top)
        for name in names
        if name.endswith(".py")
    )
    digest = hashlib.sha1("".join(f"{f}{os.path.getmtime(f)}" for f in files).encode()).hexdigest()
    path = os.path.join(tempfile.mkdtemp(prefix="featureflow-"), f"featureflow-{digest[:12]}.zip")
    with zipfile.ZipFile(path, "w") as z:
        for f in files:
            z.write(f, os.path.relpath(f, os.path.dirname(top)))
    sc.addPyFile(path)
    sc._featureflow_shipped = True


def text_slices(batch: pa.RecordBatch, column: str = "text", chars: int = BATCH_CHARS) -> Iterator[tuple[int, list[str | None]]]:
    """(first row, texts) in slices of about ``chars`` characters, so that the
    decoded strings in memory do not grow with the Arrow batch."""
    values = batch.column(column)
    first, held, out = 0, 0, []
    for k in range(len(values)):
        text = values[k].as_py()
        out.append(text)
        held += len(text or "")
        if held >= chars:
            yield first, out
            first, held, out = k + 1, 0, []
    if out:
        yield first, out


#: Bytes of a text that are cut into words at once.
WORD_CHUNK = 1 << 22
_SPACE = re.compile(rb"[\x20\x09-\x0D]")


def word_chunks(raw: bytes, size: int | None = None) -> Iterator[list[bytes]]:
    """The words of ``raw`` between ASCII white space, in lists, so that a very
    long text never has all its words in memory as objects."""
    size, at = size or WORD_CHUNK, 0
    while at < len(raw):
        end = len(raw)
        if at + size < end:
            found = _SPACE.search(raw, at + size)
            end = found.start() if found else end
        yield raw[at:end].split()
        at = end


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared scratch folder and read it back: lineage is
    cut, and a lost executor costs no recomputation of what came before."""
    spark = df.sparkSession
    path = scratch_dir(spark, label)
    schema = df.schema
    df.write.parquet(path)
    return spark.read.schema(schema).parquet(path)


def shared_folder(spark: SparkSession, label: str) -> str:
    """URI of a new folder on the shared store, for files that tasks write."""
    path = ensure_dir(spark, scratch_dir(spark, label))
    return path if "://" in path or path.startswith("file:") else "file://" + os.path.abspath(path)


def file_system(uri: str):
    """(pyarrow file system, path) of a ``file``, ``hdfs``, ``s3``, ``gs`` URI."""
    from pyarrow import fs

    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri[len("file:"):]
    return fs.FileSystem.from_uri(uri)


def drop_folder(uri: str) -> None:
    """Delete a folder that ``shared_folder`` made, once its files are used."""
    fs, path = file_system(uri)
    fs.delete_dir(path)


class AtomicFile:
    """A file that appears under its name only when it is whole.  A task that
    is run again (lost executor, speculation) replaces it by an equal one."""

    def __init__(self, fs, path: str):
        self.fs, self.path, self.temporary = fs, path, f"{path}.{uuid.uuid4().hex}.tmp"
        self.out = fs.open_output_stream(self.temporary)

    def write(self, data) -> None:
        self.out.write(data)

    def commit(self) -> None:
        self.out.close()
        self.fs.move(self.temporary, self.path)


def own_names(columns: list[str], *wanted: str) -> list[str]:
    """The wanted column names, lengthened where ``columns`` has them."""
    taken = {c.lower() for c in columns}

    def free(name: str) -> str:
        return free(name + "_") if name.lower() in taken else name

    return [free(name) for name in wanted]


def held_out(doc_id: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 4, is 2; false for a null id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def row_bucket(n: int, *columns: str) -> Column:
    """A number below ``n`` spread evenly over rows."""
    return F.pmod(F.xxhash64(*columns), F.lit(n)).cast("int")
