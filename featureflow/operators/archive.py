"""Topic archive: raw batches, folded into files by date beside running readers.

The archive job writes a folder per micro-batch (``run_id=R/batch_id=B``), as
many as 43,200 a day.  ``TopicArchive.compact`` folds them into a generation of
files by date, and names what makes up the archive in a new manifest: the last
batch folded in of every run, and the generations of every date.  Manifests are
numbered and created only if absent, so readers always see a whole one, and of
two compactions at once one wins.

A date's rows are folded together with its last generation while that is small
(``fold_rows``), so a date has one file set per ``fold_rows`` rows and one small
one at most, whatever the number of batches.  Spark's rebalancing deals a date's
rows to files of the advisory size, so a date of any share is split.

Readers pin a manifest: they read its generations and the raw batches that it has
not folded in, also those that come later.  Nothing that a pinned or one of the
two newest manifests needs is deleted by ``expire``, so a compaction changes
neither the rows of a running replay nor its place in its checkpoint.  A run's
newest batch, the only one that its stream may write again, is never folded in
unless the run is named as ended.

Defined results: an archive without rows reads as empty; rows without a time have
the date ``none``; fields that a file does not have are null.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Collection
from dataclasses import asdict, dataclass, field
from datetime import date as Date

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from featureflow.config import InputSpec
from featureflow.functions.codec import CORRUPT, REASON
from featureflow.functions.schema import quote, to_struct
from featureflow.session import create_marker, delete_dir, ensure_dir, is_missing_path, list_dirs, list_files, read_marker
from featureflow.sources.files import folder_location

NO_DATE = "none"
KEY, TIME = "_key", "_timestamp"
_GENERATION, _DATE, _RUN, _BATCH = "generation", "date", "run_id", "batch_id"


@dataclass(frozen=True)
class Manifest:
    """What makes up an archive: by run the last batch folded in, and by date
    the generations that hold its rows with their row counts."""

    number: int = 0
    folded: dict[str, int] = field(default_factory=dict)
    dates: dict[str, list[tuple[str, int]]] = field(default_factory=dict)

    @property
    def generations(self) -> set[str]:
        return {g for held in self.dates.values() for g, _ in held}

    def between(self, since: Date | None, until: Date | None) -> list[str]:
        """Dates from ``since`` to ``until`` (both inclusive), in order; rows
        without a time come first, and only if nothing is asked for."""
        named = sorted(d for d in self.dates if d != NO_DATE and (since is None or d >= since.isoformat())
                       and (until is None or d <= until.isoformat()))
        return [NO_DATE] * (since is None and until is None and NO_DATE in self.dates) + named


class TopicArchive:
    """One topic's archive of one app.  ``time_column`` (a field of the topic or
    the record's own time) says which date a row belongs to."""

    def __init__(self, base: str, app_name: str, inp: InputSpec, time_column: str = TIME, fold_rows: int = 5_000_000):
        self.raw = folder_location(base, app_name, inp.topic)
        self.folded = f"{base.rstrip('/')}/{app_name}/_folded/{inp.topic}"
        self.schema = to_struct(inp.topic_schema)
        self.time_column, self.fold_rows = time_column, fold_rows
        names = self.schema.fieldNames()
        more = [(REASON, T.StringType()), (CORRUPT, T.StringType()), (KEY, T.StringType()), (TIME, T.TimestampType())]
        self.record = T.StructType([*self.schema.fields, *(T.StructField(n, t) for n, t in more if n not in names)])
        if time_column not in self.record.fieldNames():
            raise ValueError(f"the archive of {inp.topic!r} has no column {time_column!r}")

    # ------------------------------------------------------------- manifests
    def manifest(self, spark: SparkSession, number: int | None = None) -> Manifest:
        """The newest manifest (number 0, of nothing, if there is none), or the
        one with a number."""
        if number is None:
            number = max(self._numbers(spark), default=0)
        text = read_marker(spark, f"{self.folded}/manifests/{number:08d}") if number else None
        if text is None:
            if number:
                raise ValueError(f"{self.folded} has no manifest {number}")
            return Manifest()
        made = json.loads(text)
        return Manifest(made["number"], made["folded"], {d: [tuple(x) for x in held] for d, held in made["dates"].items()})

    def _numbers(self, spark: SparkSession) -> list[int]:
        return sorted(int(n) for n in list_files(spark, f"{self.folded}/manifests") if n.isdigit())

    def pin(self, spark: SparkSession, name: str) -> Manifest:
        """The manifest that reader ``name`` is bound to: the newest one when it
        first asks.  ``expire`` keeps what it needs until ``unpin``."""
        marker = f"{self.folded}/pins/{name}"
        newest = self.manifest(spark)
        create_marker(spark, marker, str(newest.number))
        return self.manifest(spark, int(read_marker(spark, marker)))

    def unpin(self, spark: SparkSession, name: str) -> None:
        delete_dir(spark, f"{self.folded}/pins/{name}", f"{self.folded}/pins")

    # ------------------------------------------------------------------ rows
    def _batches(self, spark: SparkSession) -> dict[str, list[int]]:
        """Raw batches by run, from the folder names."""
        return {r.removeprefix(f"{_RUN}="): sorted(int(b.removeprefix(f"{_BATCH}=")) for b in list_dirs(spark, f"{self.raw}/{r}"))
                for r in list_dirs(spark, self.raw) if r.startswith(f"{_RUN}=")}

    def _raw_schema(self) -> T.StructType:
        return T.StructType([*self.record.fields, T.StructField(_RUN, T.StringType()), T.StructField(_BATCH, T.LongType())])

    def _folded_schema(self) -> T.StructType:
        return T.StructType([*self.record.fields, T.StructField(_GENERATION, T.StringType()), T.StructField(_DATE, T.StringType())])

    @staticmethod
    def _after(folded: dict[str, int]) -> Column:
        """Raw batches beyond the fold points: literal partition filters."""
        out = F.lit(True)
        for run, last in sorted(folded.items()):
            out = out & ~((F.col(_RUN) == run) & (F.col(_BATCH) <= last))
        return out

    @staticmethod
    def _held(dates: dict[str, list[tuple[str, int]]]) -> Column:
        """(generation, date) folders, as literal partition filters."""
        by: dict[str, list[str]] = {}
        for d, held in dates.items():
            for generation, _ in held:
                by.setdefault(generation, []).append(d)
        out = F.lit(False)
        for generation, own in sorted(by.items()):
            out = out | ((F.col(_GENERATION) == generation) & F.col(_DATE).isin(sorted(own)))
        return out

    def _date(self) -> Column:
        return F.coalesce(F.to_date(F.col(quote(self.time_column))).cast("string"), F.lit(NO_DATE))

    def _read(self, spark: SparkSession, path: str, schema: T.StructType, wanted: Column) -> DataFrame:
        try:
            rows = spark.read.schema(schema).parquet(path)
        except AnalysisException as exc:
            if not is_missing_path(exc):
                raise
            rows = spark.createDataFrame([], schema)
        return rows.where(wanted).select(*(F.col(quote(c)) for c in self.record.fieldNames()))

    def read(self, spark: SparkSession, since: Date | None = None, until: Date | None = None,
             manifest: Manifest | None = None) -> DataFrame:
        """All records (also those that did not decode), or those of some
        dates: of the folded ones only their folders are read."""
        m = manifest or self.manifest(spark)
        dates = {d: m.dates[d] for d in m.between(since, until)}
        raw = self._read(spark, self.raw, self._raw_schema(), self._after(m.folded))
        if since is not None or until is not None:
            low, high = since or Date.min, until or Date.max
            raw = raw.where(F.col(quote(self.time_column)).cast("date").between(F.lit(low), F.lit(high)))
        return raw.unionByName(self._read(spark, f"{self.folded}/data", self._folded_schema(), self._held(dates)))

    def stream(self, spark: SparkSession, manifest: Manifest, options: dict[str, str]) -> DataFrame:
        """Decoded rows of a pinned manifest's generations and of all raw
        batches that it has not folded in, as they come."""
        raw = self._stream(spark, self.raw, self._raw_schema(), options).where(self._after(manifest.folded))
        if manifest.number:
            folded = self._stream(spark, f"{self.folded}/data", self._folded_schema(), options).where(self._held(manifest.dates))
            raw = self._decoded(raw).unionByName(self._decoded(folded))
            return raw
        return self._decoded(raw)

    def slices(self, manifest: Manifest, slice_rows: int) -> list[list[str]]:
        """Parts of a replay in time order: runs of dates that together have
        ``slice_rows`` rows at most (or one date), then the raw batches that are
        not folded in (an empty list)."""
        out: list[list[str]] = []
        held = 0
        for d in manifest.between(None, None):
            n = sum(rows for _, rows in manifest.dates[d])
            if not out or held + n > slice_rows:
                out.append([])
                held = 0
            out[-1].append(d)
            held += n
        return [*out, []]

    def stream_slice(self, spark: SparkSession, manifest: Manifest, dates: list[str], options: dict[str, str]) -> DataFrame:
        """Decoded rows of one slice."""
        if not dates:
            return self._decoded(self._stream(spark, self.raw, self._raw_schema(), options).where(self._after(manifest.folded)))
        own = {d: manifest.dates[d] for d in dates if d in manifest.dates}
        root, generations = f"{self.folded}/data", sorted({g for held in own.values() for g, _ in held})
        if not own:
            return self._decoded(self._stream(spark, f"{self.folded}/no-data", self.record, options))
        path = f"{root}/{_GENERATION}={{{','.join(generations)}}}/{_DATE}={{{','.join(sorted(own))}}}"
        rows = self._stream(spark, path, self._folded_schema(), {**options, "basePath": root})
        return self._decoded(rows.where(self._held(own)))

    def _stream(self, spark: SparkSession, path: str, schema: T.StructType, options: dict[str, str]) -> DataFrame:
        if "{" not in path:
            ensure_dir(spark, path)
        return spark.readStream.schema(schema).options(**options).parquet(path)

    def _decoded(self, rows: DataFrame) -> DataFrame:
        return rows.where(F.col(REASON).isNull()).select(*(F.col(quote(c)) for c in self.schema.fieldNames()))

    # ------------------------------------------------------------ maintenance
    def compact(self, spark: SparkSession, ended: Collection[str] = ()) -> Manifest:
        """Fold new raw batches in; the newest manifest afterwards.  Batches of
        the runs ``ended`` are folded in to the last one."""
        before = self.manifest(spark)
        last = {run: (own if run in ended else own[:-1])[-1:] for run, own in self._batches(spark).items()}
        points = {run: own[0] for run, own in last.items() if own and own[0] > before.folded.get(run, -1)}
        if not points:
            return before
        new = F.lit(False)
        for run, to in sorted(points.items()):
            new = new | ((F.col(_RUN) == run) & F.col(_BATCH).between(before.folded.get(run, -1) + 1, to))
        rows = self._read(spark, self.raw, self._raw_schema(), new).withColumn(_DATE, self._date())
        touched = {r[_DATE]: r["n"] for r in rows.groupBy(_DATE).agg(F.count("*").alias("n")).collect()}  # one row per date
        number = before.number + 1
        dates = {d: list(held) for d, held in before.dates.items()}
        again: dict[str, list[tuple[str, int]]] = {}
        # Two compactions may be at work: each writes under a name of its own,
        # and only one can create the manifest of this number.
        generation = f"{number:08d}-{uuid.uuid4().hex[:8]}"
        for d, n in touched.items():
            held = dates.setdefault(d, [])
            while held and held[-1][1] < self.fold_rows:
                again.setdefault(d, []).append(held.pop())
                n += again[d][-1][1]
            held.append((generation, n))
        if again:
            old = self._read(spark, f"{self.folded}/data", self._folded_schema(), self._held(again)).withColumn(_DATE, self._date())
            rows = rows.unionByName(old)
        if touched:
            rows.hint("rebalance", _DATE).write.partitionBy(_DATE).parquet(f"{self.folded}/data/{_GENERATION}={generation}")
        made = Manifest(number, {**before.folded, **points}, dates)
        create_marker(spark, f"{self.folded}/manifests/{number:08d}", json.dumps(asdict(made)))
        return self.manifest(spark)

    def expire(self, spark: SparkSession) -> tuple[int, int]:
        """Delete raw batches and generations that neither a pinned nor one of
        the two newest manifests needs; how many of each."""
        numbers = self._numbers(spark)
        if len(numbers) < 2:
            return 0, 0
        pinned = {int(read_marker(spark, f"{self.folded}/pins/{p}")) for p in list_files(spark, f"{self.folded}/pins")}
        kept = [self.manifest(spark, n) for n in sorted({*numbers[-2:], *pinned})]
        raw = generations = 0
        for run, own in self._batches(spark).items():
            to = min(m.folded.get(run, -1) for m in kept)
            raw += sum(delete_dir(spark, f"{self.raw}/{_RUN}={run}/{_BATCH}={b}", self.raw) for b in own if b <= to)
        needed = set().union(*(m.generations for m in kept))
        for name in list_dirs(spark, f"{self.folded}/data"):
            own = name.removeprefix(f"{_GENERATION}=")
            if int(own.split("-")[0]) < numbers[-1] and own not in needed:
                generations += delete_dir(spark, f"{self.folded}/data/{name}", f"{self.folded}/data")
        for n in numbers[:-2]:
            if n not in pinned:
                delete_dir(spark, f"{self.folded}/manifests/{n:08d}", f"{self.folded}/manifests")
        return raw, generations
