"""Token-id files: flat unsigned integers plus 64-bit document offsets.

``write_token_files`` sorts the documents by id over range partitions; every
partition writes its own files into one shared folder:

* ``part-NNNNNN.bin``: the ids of all its documents, each with the end id, as
  unsigned little-endian integers (16 bits if every id fits, else 32);
* ``part-NNNNNN.idx``: n + 1 signed 64-bit offsets (in ids) into that file;
* ``part-NNNNNN.doc``: n signed 64-bit document ids.

The base of a partition in the whole corpus is the prefix sum of the counts
before it (one number per partition).  ``read_token_files`` maps the files into
memory, one task per partition, and gives a row per document.

Defined results: a null text is empty (its only id is the end id); null ids
come first; rows with equal ids are ordered by text hash; an empty table gives
no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .tokens import encoder


@dataclass(frozen=True)
class TokenFiles:
    """A written corpus: folder, id width, and per partition (documents, ids,
    documents with a null id)."""

    folder: str
    dtype: str
    parts: tuple[tuple[int, int, int], ...]

    @property
    def bases(self) -> list[int]:
        """Ids before each partition."""
        return np.concatenate([[0], np.cumsum([p[1] for p in self.parts], dtype=np.int64)])[:-1].tolist()


def id_dtype(largest_id: int) -> str:
    return "<u2" if largest_id < 1 << 16 else "<u4"


def _write_part(batches: Iterator[pa.RecordBatch], folder: str, path: str, end_id: int) -> Iterator[pa.RecordBatch]:
    part = TaskContext.get().partitionId()
    enc = encoder(path)
    dtype = id_dtype(max(enc.tokenizer.get_vocab_size() - 1, end_id))
    end = np.array([end_id], "<u4").tobytes()
    fs, root = common.file_system(folder)
    stem = f"{root}/part-{part:06d}"
    files = {kind: common.AtomicFile(fs, f"{stem}.{kind}") for kind in ("bin", "idx", "doc")}
    files["idx"].write(np.zeros(1, "<i8").tobytes())
    docs = tokens = nulls = 0
    for batch in batches:
        ids = batch.column("doc_id")
        for first, texts in common.text_slices(batch):
            coded = [c + end for c in enc.encode(texts)]
            whole = np.frombuffer(b"".join(coded), "<u4")
            files["bin"].write(whole.astype(dtype).tobytes())
            lengths = np.array([len(c) // 4 for c in coded], "<i8")
            files["idx"].write((tokens + np.cumsum(lengths)).astype("<i8").tobytes())
            own = ids.slice(first, len(texts))
            nulls += own.null_count
            files["doc"].write(own.fill_null(0).to_numpy(zero_copy_only=False).astype("<i8").tobytes())
            docs, tokens = docs + len(texts), tokens + int(lengths.sum())
    for f in files.values():
        f.commit()
    yield pa.RecordBatch.from_pydict(
        {"part": [part], "docs": [docs], "tokens": [tokens], "nulls": [nulls], "dtype": [dtype]},
        pa.schema([("part", pa.int64()), ("docs", pa.int64()), ("tokens", pa.int64()), ("nulls", pa.int64()), ("dtype", pa.string())]))


def write_token_files(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int) -> TokenFiles:
    """Write ``docs`` (doc_id, text) and a ``manifest.json``; see the module."""
    common.ship_package(docs.sparkSession)
    ordered = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
        .withColumn("tie", F.xxhash64("text"))
        .repartitionByRange("doc_id", "tie")
        .sortWithinPartitions("doc_id", "tie")
    )
    rows = ordered.mapInArrow(
        lambda batches: _write_part(batches, folder, tokenizer_path, end_id),
        "part long, docs long, tokens long, nulls long, dtype string",
    ).collect()  # one row per partition
    rows = sorted(rows, key=lambda r: r["part"])
    if [r["part"] for r in rows] != list(range(len(rows))):
        raise RuntimeError("a partition of the token files is missing")
    made = TokenFiles(folder, rows[0]["dtype"] if rows else "<u4", tuple((r["docs"], r["tokens"], r["nulls"]) for r in rows))
    fs, root = common.file_system(folder)
    manifest = common.AtomicFile(fs, f"{root}/manifest.json")
    manifest.write(json.dumps(asdict(made) | {"bases": made.bases}).encode())
    manifest.commit()
    return made


def _mapped(fs, path: str, dtype: str) -> np.ndarray:
    """A file as an array: memory-mapped where it is local, else read."""
    from pyarrow import fs as pafs

    if fs.get_file_info(path).size == 0:
        return np.zeros(0, dtype)
    if isinstance(fs, pafs.LocalFileSystem):
        return np.memmap(path, dtype=dtype, mode="r")
    with fs.open_input_file(path) as f:
        return np.frombuffer(f.read(), dtype)


def open_document(files: TokenFiles, part: int, row: int) -> np.ndarray:
    """Ids of one document, by its place (random access)."""
    fs, root = common.file_system(files.folder)
    stem = f"{root}/part-{part:06d}"
    index = _mapped(fs, f"{stem}.idx", "<i8")
    return _mapped(fs, f"{stem}.bin", files.dtype)[index[row]:index[row + 1]]


_READ = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])


def _read_part(part: int, files: TokenFiles, base: int) -> Iterator[pa.RecordBatch]:
    fs, root = common.file_system(files.folder)
    stem = f"{root}/part-{part:06d}"
    ids = _mapped(fs, f"{stem}.bin", files.dtype)
    index = _mapped(fs, f"{stem}.idx", "<i8")
    doc = _mapped(fs, f"{stem}.doc", "<i8")
    n, tokens, nulls = files.parts[part]
    if len(doc) != n or len(index) != n + 1 or len(ids) != tokens or (n and int(index[-1]) != tokens):
        raise RuntimeError(f"{stem}: the files do not match the manifest")
    for at in range(0, n, 8192):
        cuts = np.asarray(index[at:min(at + 8192, n) + 1])
        block = np.asarray(ids[cuts[0]:cuts[-1]]).astype("<u4")
        places = cuts - cuts[0]
        crc = [zlib.crc32(block[a:b]) for a, b in zip(places[:-1].tolist(), places[1:].tolist())]
        rows = len(crc)
        null = np.arange(at, at + rows) < nulls  # null ids are first
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.asarray(doc[at:at + rows]), mask=null), pa.array(base + cuts[:-1]), pa.array(np.diff(cuts)), pa.array(crc, pa.int64())],
            schema=_READ)


def read_token_files(spark: SparkSession, files: TokenFiles) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""
    common.ship_package(spark)
    bases = files.bases

    def read(batches):
        for batch in batches:
            for part in batch.column("id").to_pylist():
                yield from _read_part(part, files, bases[part])

    n = len(files.parts)
    return spark.range(0, n, 1, max(1, n)).mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")
