"""Keyed feature table: latest row per primary key, per code version.

Built-in Parquet tables have no MERGE, so the table is a changelog plus a
view.  Every micro-batch is written to its own folder
``code_version=V/run_id=R/batch_id=B``, which a re-executed batch replaces
(also by nothing), with the time of its first commit.  The latest row per key
is one aggregation, ``max_by(row, ordering)`` grouped by the primary key: it
aggregates partially before the shuffle, so a hot key sends one row per map
task, never its whole history.  ``compact`` folds the changelog into a snapshot
in key buckets, of which it rewrites only those that new batches touch, so that
reads stay proportional to the number of keys plus the newest batches.
"""

from __future__ import annotations

import json
import time
from datetime import datetime
from typing import Any, Sequence

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from featureflow.config import TableSpec
from featureflow.functions.schema import check_primary_keys, conform, quote, to_struct
from featureflow.session import create_marker, delete_dir, is_missing_path, list_dirs, read_marker
from featureflow.streaming.runner import BatchWriter
from featureflow.streaming.sinks import write_batch_folder

COMMITTED = "_committed"
META_FIELDS = [
    T.StructField("code_version", T.IntegerType()),
    T.StructField("run_id", T.StringType()),
    T.StructField("batch_id", T.LongType()),
]
STAMP = T.StructField(COMMITTED, T.LongType())
FOLD_POINTS = "_fold_points.json"
BUCKET = "_bucket"
# Key buckets of a table's snapshots; a snapshot keeps the number it began with.
BUCKETS = 64

# Rows of a changelog or snapshot file.  Reads sort a scan task's rows by key (the
# partial step of the latest view); a file of one row group is one task.
FILE_ROWS = 500_000

# Key lists of up to this many tuples are also pushed to the scan.
PUSHDOWN_KEYS = 1_000


def _key_text(value: Any, whole: bool) -> str | None:
    if value is None or isinstance(value, str):
        return value
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, (bytes, bytearray)):
        return bytes(value).decode("utf-8")
    if isinstance(value, datetime):
        return value.isoformat(sep=" ")
    if isinstance(value, float) and whole and value.is_integer():
        return str(int(value))
    return str(value)


def _orderable(dtype: T.DataType) -> bool:
    if isinstance(dtype, T.MapType):
        return False
    if isinstance(dtype, T.StructType):
        return all(_orderable(f.dataType) for f in dtype.fields)
    if isinstance(dtype, T.ArrayType):
        return _orderable(dtype.elementType)
    return True


class FeatureStore:
    """Changelog + latest view for one app's output table.

    ``order_by`` names output columns that decide which row is newest for a
    key; tables without it go by the time at which a row's batch was first
    committed (last write wins, over all runs; the writers' clocks must agree
    to that extent).  Ties fall back to the batch id and then the remaining
    columns.
    """

    def __init__(self, root: str, table: TableSpec):
        self.root = root.rstrip("/")
        self.schema = to_struct(table.output_schema)
        self.keys = check_primary_keys(table.primary_keys, self.schema)
        self.order_by = list(table.order_by or [])
        unknown = [c for c in self.order_by if c not in self.schema.fieldNames()]
        if unknown:
            raise ValueError(f"order_by columns {unknown} are not output fields")
        unordered = [c for c in self.order_by if not _orderable(self.schema[c].dataType)]
        if unordered:
            raise ValueError(f"order_by columns {unordered} cannot be ordered (maps)")

    # ---------------------------------------------------------------- write
    @property
    def changelog_path(self) -> str:
        return f"{self.root}/changelog"

    @property
    def snapshot_path(self) -> str:
        return f"{self.root}/snapshots"

    def writer(self, code_version: int, run_id: str) -> BatchWriter:
        """``foreachBatch`` writer: conform to the declared schema, stamp the
        batch and replace that batch's partition."""
        def write(batch_df: DataFrame, batch_id: int) -> None:
            self.write_batch(batch_df, code_version, run_id, batch_id)
        return write

    def write_batch(self, df: DataFrame, code_version: int, run_id: str, batch_id: int) -> None:
        """Replace the batch's rows; a batch that is written again keeps the
        time of its first commit, so its rank among other runs' rows stays."""
        place = {"code_version": code_version, "run_id": run_id, "batch_id": batch_id}
        marker = "/".join([f"{self.root}/commits", *(f"{k}={v}" for k, v in place.items())])
        spark = df.sparkSession
        create_marker(spark, marker, str(time.time_ns() // 1000))
        stamped = conform(df, self.schema).withColumn(COMMITTED, F.lit(int(read_marker(spark, marker))).cast("long"))
        write_batch_folder(stamped, self.changelog_path, place, FILE_ROWS)

    # ----------------------------------------------------------------- read
    def _read(self, spark: SparkSession, base: str, path: str,
              extra: Sequence[T.StructField]) -> DataFrame:
        schema = T.StructType(list(self.schema.fields) + list(extra))
        try:
            return spark.read.schema(schema).option("basePath", base).parquet(path)
        except AnalysisException as exc:
            if not is_missing_path(exc):
                raise
            return spark.createDataFrame([], schema)

    def changelog(self, spark: SparkSession, code_version: int,
                  run_id: str | None = None) -> DataFrame:
        """All written rows of one code version (and run).  Only that
        version's (run's) folder is listed; partition values still come
        from the paths."""
        path = f"{self.changelog_path}/code_version={code_version}"
        if run_id is not None:
            path += f"/run_id={run_id}"
        log = self._read(spark, self.changelog_path, path, [STAMP, *META_FIELDS])
        log = log.filter(F.col("code_version") == F.lit(code_version))
        if run_id is not None:
            log = log.filter(F.col("run_id") == F.lit(run_id))
        return log

    def _ordering(self) -> list[str]:
        rest = [f.name for f in self.schema.fields
                if f.name not in self.keys and f.name not in self.order_by
                and _orderable(f.dataType)]
        return [*(self.order_by or [COMMITTED]), "batch_id", *rest]

    def _newest(self, rows: DataFrame, *also: str) -> DataFrame:
        """Newest row per primary key (and the columns ``also``)."""
        values = [f.name for f in self.schema.fields if f.name not in self.keys]
        values += [COMMITTED, "batch_id"]
        payload = F.struct(*[F.col(quote(c)) for c in values])
        ordering = F.struct(*[F.col(quote(c)) for c in self._ordering()])
        group = [*also, *(quote(k) for k in self.keys)]
        agg = rows.groupBy(*group).agg(F.max_by(payload, ordering).alias("_v"))
        return agg.select(*group, *[F.col("_v")[c].alias(c) for c in values])

    def _rows(self, spark: SparkSession, code_version: int, run_id: str | None,
              request: DataFrame | None = None) -> DataFrame:
        """Changelog rows plus the newest snapshot, minus what it folded in.

        The fold points (one per run) become literal partition filters, so
        after a compaction only the batches written since are listed and read.
        Of the snapshot only the buckets that the keys of ``request`` fall into
        are read.
        """
        rows = self.changelog(spark, code_version, run_id)
        snap = self._snapshot(spark, code_version, run_id, request)
        if snap is not None:
            snap_rows, folded, _ = snap
            rows = rows.filter(_after(folded)).select(snap_rows.columns).unionByName(snap_rows)
        return rows

    def latest(self, spark: SparkSession, code_version: int,
               run_id: str | None = None) -> DataFrame:
        """Latest row per primary key, in declared column order."""
        rows = self._rows(spark, code_version, run_id)
        return self._newest(rows).select(*[F.col(quote(n)) for n in self.schema.fieldNames()])

    def scan(self, spark: SparkSession, code_version: int,
             run_id: str | None = None) -> DataFrame:
        """Latest records for all keys."""
        return self.latest(spark, code_version, run_id)

    def lookup(self, spark: SparkSession, code_version: int, keys: Any,
               run_id: str | None = None) -> DataFrame:
        """Latest row for each requested key; unknown keys give null features.

        ``keys`` is a DataFrame or a list of tuples whose values are matched to
        the primary keys *by position* and cast to their types; text is
        accepted for every type.  Only the snapshot's buckets of the requested
        keys are read.  A request of up to ``PUSHDOWN_KEYS`` keys, list or frame,
        also becomes filters of the scan, which skip files and row groups by key
        ranges and Bloom filters.  A key list, whose size Spark knows, is
        semi-joined below the aggregation, so only rows of the requested keys
        are aggregated (Spark broadcasts a short one).  A key frame may be of
        any size, so the aggregation comes first and keeps its partial step
        before the shuffle, which a hot key needs; the join then sees one row
        per key.
        """
        if keys is None:
            raise ValueError("key values are required")
        texts = None
        if not isinstance(keys, DataFrame):
            texts = self._key_texts(keys)
            names = [f"_{i}" for i in range(len(self.keys))]
            columns = [pa.array([t[i] for t in texts], pa.string()) for i in range(len(self.keys))]
            keys = spark.createDataFrame(pa.table(columns, names=names))  # of a size that Spark knows
        if len(keys.columns) != len(self.keys):
            raise ValueError(f"expected {len(self.keys)} key columns, got {len(keys.columns)}")
        req = keys.select(*[F.col(quote(c)).cast(self.schema[k].dataType).alias(k)
                            for c, k in zip(keys.columns, self.keys)])
        rows = self._rows(spark, code_version, run_id, req)
        if texts is not None:
            found = self._newest(self._pushed(rows, texts).join(req, self.keys, "left_semi"))
        else:
            # A frame's keys as texts, if they are few.
            asked = req.select(*[F.col(quote(k)).cast("string") for k in self.keys]).distinct().limit(PUSHDOWN_KEYS + 1).collect()
            found = self._newest(self._pushed(rows, [tuple(r) for r in asked])).join(req, self.keys, "left_semi")
        return req.join(found, self.keys, "left").select(
            *[F.col(quote(n)) for n in self.schema.fieldNames()])

    def _key_texts(self, keys: Sequence[Any]) -> list[tuple[str | None, ...]]:
        """A key list as texts, which are cast to the key types like the
        columns of a key frame, so that a list and a frame mean the same."""
        tuples = [tuple(k) if isinstance(k, (list, tuple)) else (k,) for k in keys]
        if any(len(t) != len(self.keys) for t in tuples):
            raise ValueError(f"every key needs {len(self.keys)} values, in write order")
        whole = [isinstance(self.schema[k].dataType, T.IntegralType) for k in self.keys]
        return [tuple(_key_text(v, w) for v, w in zip(t, whole)) for t in tuples]

    def _pushed(self, rows: DataFrame, texts: list[tuple[str | None, ...]]) -> DataFrame:
        """A short key list also as IN filters, which reach the Parquet scan
        and skip files and row groups by their key ranges (snapshots are
        clustered by key).  The literals are cast as the keys are; it only
        saves reading, the join decides.  Not for floating-point keys, whose
        zeros and NaN a scan compares in its own way."""
        if len(texts) > PUSHDOWN_KEYS:
            return rows
        for i, k in enumerate(self.keys):
            dtype = self.schema[k].dataType
            if not isinstance(dtype, T.FractionalType | T.BinaryType) or isinstance(dtype, T.DecimalType):
                values = sorted({t[i] for t in texts if t[i] is not None})
                rows = rows.filter(F.col(quote(k)).isin([F.lit(v).cast(dtype) for v in values]))
        return rows

    # ----------------------------------------------------------- compaction
    def _snapshot_ids(self, spark: SparkSession, base: str) -> list[int]:
        ids = [int(d.split("=", 1)[1]) for d in list_dirs(spark, base)
               if d.startswith("snapshot_id=")]
        return sorted(ids, reverse=True)

    def _manifest(self, spark: SparkSession, base: str, snap_id: int) -> dict | None:
        """What a snapshot holds: the last folded batch by run, and where its
        buckets lie; None if it is not complete (or its marker is damaged)."""
        text = read_marker(spark, f"{base}/snapshot_id={snap_id}/{FOLD_POINTS}")
        try:
            found = json.loads(text or "")
            return {"folded": {r: int(b) for r, b in found["folded"].items()},
                    "buckets": {int(b): int(i) for b, i in found["buckets"].items()},
                    "of": int(found["of"])}
        except (ValueError, KeyError, TypeError, AttributeError):
            return None

    def _complete(self, spark: SparkSession, code_version: int) -> list[tuple[int, dict]]:
        """(id, manifest) of the complete snapshots, newest first.  Found by
        listing folders and reading small files; no Spark job."""
        base = f"{self.snapshot_path}/code_version={code_version}"
        found = ((i, self._manifest(spark, base, i)) for i in self._snapshot_ids(spark, base))
        return [(i, m) for i, m in found if m is not None]

    def _bucket(self, of: int) -> Column:
        return F.pmod(F.xxhash64(*[F.col(quote(k)) for k in self.keys]), F.lit(of)).cast("int")

    def _bucket_rows(self, spark: SparkSession, code_version: int, buckets: dict[int, int]) -> DataFrame:
        """Rows of snapshot buckets, given the snapshot that holds each."""
        base = f"{self.snapshot_path}/code_version={code_version}"
        schema = T.StructType([*self.schema.fields, STAMP, *META_FIELDS[1:]])
        paths = [f"{base}/snapshot_id={i}/rows/{BUCKET}={b}" for b, i in sorted(buckets.items())]
        rows = spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)
        return rows.withColumn("code_version", F.lit(code_version).cast("int"))

    def _snapshot(self, spark: SparkSession, code_version: int, run_id: str | None, request: DataFrame | None = None):
        """Newest complete snapshot: (rows, {run_id: last folded batch}, id);
        with a request only the buckets of its keys."""
        for snap_id, manifest in self._complete(spark, code_version):
            folded = {r: b for r, b in manifest["folded"].items() if run_id is None or r == run_id}
            buckets = manifest["buckets"]
            if request is not None:
                asked = {r[0] for r in request.select(self._bucket(manifest["of"])).distinct().collect()}  # at most ``of``
                buckets = {b: i for b, i in buckets.items() if b in asked}
            rows = self._bucket_rows(spark, code_version, buckets)
            if run_id is not None:
                rows = rows.filter(F.col("run_id") == run_id)
            return rows, folded, snap_id
        return None

    def expire(self, spark: SparkSession, code_version: int) -> int:
        """Delete what no reader can need any more; return the folders removed.

        Kept: the newest and the previous complete snapshot with all snapshots
        that hold buckets of theirs, and every changelog batch after the
        previous snapshot's fold points, so readers that started on either
        snapshot still find their rows.  Removed: other older snapshots and
        the batches that the previous snapshot had already folded in.  Safe to
        repeat.
        """
        base = f"{self.snapshot_path}/code_version={code_version}"
        complete = self._complete(spark, code_version)[:2]
        if len(complete) < 2:
            return 0
        keep_from, previous = complete[1]
        needed = {i for _, m in complete for i in m["buckets"].values()}
        removed = 0
        for snap_id in self._snapshot_ids(spark, base):
            if snap_id < keep_from and snap_id not in needed:
                removed += delete_dir(spark, f"{base}/snapshot_id={snap_id}", self.root)
        place = f"code_version={code_version}"
        for run, last in previous["folded"].items():
            run_dir = f"{self.changelog_path}/{place}/run_id={run}"
            for d in list_dirs(spark, run_dir):
                if d.startswith("batch_id=") and int(d.split("=", 1)[1]) <= last:
                    removed += delete_dir(spark, f"{run_dir}/{d}", self.root)
                    delete_dir(spark, f"{self.root}/commits/{place}/run_id={run}/{d}", self.root)
        return removed

    def _newest_batches(self, spark: SparkSession, code_version: int) -> dict[str, int]:
        """The last batch of every run, from folder names (no Spark job)."""
        base, out = f"{self.changelog_path}/code_version={code_version}", {}
        for run_dir in list_dirs(spark, base):
            if run_dir.startswith("run_id="):
                batches = [int(d.split("=", 1)[1]) for d in list_dirs(spark, f"{base}/{run_dir}")
                           if d.startswith("batch_id=")]
                if batches:
                    out[run_dir.split("=", 1)[1]] = max(batches)
        return out

    def compact(self, spark: SparkSession, code_version: int) -> int:
        """Fold everything written so far into a new snapshot and return its id.

        The snapshot keeps, per run, the newest row of every key and records
        the last batch folded in for each run (all but the run's newest
        batch, which its stream may still rewrite).  It is kept in buckets of
        the key: only buckets that the new batches touch are read and written,
        the others stay where an earlier snapshot put them.  Older snapshots
        and the changelog are left in place; readers take the newest snapshot
        plus the batches beyond it.  With no new batches nothing is written
        and the previous id is returned.  Single writer.
        """
        base = f"{self.snapshot_path}/code_version={code_version}"
        complete = self._complete(spark, code_version)
        prev, old = complete[0] if complete else (None, {"folded": {}, "buckets": {}, "of": BUCKETS})
        folded, of = old["folded"], old["of"]
        snap_id = max([prev or 0, *self._snapshot_ids(spark, base)]) + 1
        # Fix the new fold points first, then fold only up to them: batches
        # that land meanwhile stay in the changelog for readers.  A run's
        # newest batch is left out: its stream may still re-run it (a batch is
        # committed to the checkpoint only after its write).
        newest = self._newest_batches(spark, code_version)
        last = {run: b - 1 for run, b in newest.items() if b - 1 > folded.get(run, -1)}
        if not last:
            return prev or 0
        new = self.changelog(spark, code_version).filter(_after(folded)).filter(_up_to(last))
        touched = [r[0] for r in new.select(self._bucket(of)).distinct().collect()]  # at most ``of``
        held = {b: i for b, i in old["buckets"].items() if b in set(touched)}
        rows = new.unionByName(self._bucket_rows(spark, code_version, held))
        # Clustered by key, so key filters of lookups skip files and row groups.
        order = [F.col(BUCKET), *[F.col(quote(k)) for k in self.keys]]
        (self._newest(rows, "run_id").withColumn(BUCKET, self._bucket(of))
         .repartitionByRange(*order).sortWithinPartitions(*order)
         .write.mode("overwrite").options(**{f"parquet.bloom.filter.enabled#{k}": "true" for k in self.keys})
         .option("maxRecordsPerFile", FILE_ROWS).partitionBy(BUCKET).parquet(f"{base}/snapshot_id={snap_id}/rows"))
        # The manifest is written last: a snapshot without it is never read.
        manifest = {"folded": {**folded, **last}, "of": of,
                    "buckets": {**old["buckets"], **dict.fromkeys(touched, snap_id)}}
        if not create_marker(spark, f"{base}/snapshot_id={snap_id}/{FOLD_POINTS}", json.dumps(manifest, sort_keys=True)):
            raise RuntimeError(f"snapshot {snap_id} was written by another compaction")
        return snap_id


def _after(folded: dict[str, int]) -> Column:
    """Rows of batches after their run's fold point (runs not folded: all)."""
    cond = ~F.col("run_id").isin(list(folded)) if folded else F.lit(True)
    for run, last in folded.items():
        cond = cond | ((F.col("run_id") == F.lit(run)) & (F.col("batch_id") > F.lit(last)))
    return cond


def _up_to(points: dict[str, int]) -> Column:
    """Rows of batches up to their run's fold point."""
    cond = F.lit(False)
    for run, last in points.items():
        cond = cond | ((F.col("run_id") == F.lit(run)) & (F.col("batch_id") <= F.lit(last)))
    return cond
