"""Session helpers: a local session for tests and benches, and the shared
scratch folder every job writes its intermediate tables and checkpoints to."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"


# State of large keyed streams on disk; set STATE_STORE_CONF to it.
STATE_STORE_CONF = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def build_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  app_name: str = "featureflow", rocksdb: bool = False) -> SparkSession:
    """A local session with AQE on and the UI off (tests, bench).  ``rocksdb``
    keeps the state of streams in RocksDB instead of on the heap."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app_name)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.streaming.forceDeleteTempCheckpointLocation", "true")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    if rocksdb:
        spark.conf.set(STATE_STORE_CONF, ROCKSDB)
    return spark


def _context(spark: SparkSession):
    """The SparkContext, or None under Spark Connect."""
    try:
        return spark.sparkContext
    except Exception:
        return None


def _checkpoint_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    On a cluster this is set by the deployment and points at shared storage;
    it is read, never replaced.  Only a local session (as in tests) may leave
    it unset: a fresh folder of this machine is then registered as the
    context's checkpoint folder (the setting itself cannot change at runtime).
    On any other master a machine's own folder would hide files from the
    other machines, so that is an error.
    """
    root = spark.conf.get(CHECKPOINT_CONF, None)
    sc = _context(spark)
    if not root and sc is not None:
        root = sc.getCheckpointDir()
    if not root:
        if sc is None or not sc.master.split("[")[0] == "local":
            raise ValueError(f"{CHECKPOINT_CONF} must name a shared folder")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="featureflow-"))
        root = sc.getCheckpointDir()
    return root.rstrip("/")


def scratch_dir(spark: SparkSession, label: str) -> str:
    """A new, unique folder under the shared checkpoint root.  It is noted, so
    that ``clear_scratch`` can delete it."""
    path = f"{_checkpoint_root(spark)}/featureflow/{label}-{uuid.uuid4().hex[:12]}"
    sc = _context(spark)
    if sc is not None:
        _SCRATCH.setdefault(id(sc), []).append(path)
    return path


_SCRATCH: dict[int, list[str]] = {}


def clear_scratch(spark: SparkSession) -> int:
    """Delete the scratch folders that this driver has made so far; their
    number.  Call it when the results that were read from them are consumed."""
    paths = _SCRATCH.pop(id(_context(spark)), [])
    root = _checkpoint_root(spark)
    return sum(delete_dir(spark, p, f"{root}/featureflow") for p in paths)


# Small marker files on the shared file system (any Hadoop file system),
# written and read by the driver without running a Spark job.

def _hadoop_path(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def read_marker(spark: SparkSession, path: str) -> str | None:
    """Text of a small file, or None when it does not exist."""
    fs, p = _hadoop_path(spark, path)
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    try:
        data = spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)
    finally:
        stream.close()
    return bytes(data).decode("utf-8")


def create_marker(spark: SparkSession, path: str, text: str) -> bool:
    """Create a small file holding ``text``; False if it already exists.

    The text is written under a temporary name and renamed, so a file under
    ``path`` is always whole, whatever happens to its writer.  Any failure
    other than losing to another writer is raised."""
    fs, p = _hadoop_path(spark, path)
    if fs.exists(p):
        return False
    jvm = spark.sparkContext._jvm
    temporary = jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}.tmp")
    out = fs.create(temporary, False)
    try:
        out.write(bytearray(text.encode("utf-8")))
    finally:
        out.close()
    if fs.getUri().getScheme() == "file":  # a local rename replaces; a link does not
        try:
            os.link(temporary.toUri().getPath(), p.toUri().getPath())
        except FileExistsError:  # another writer was first
            return False
        finally:
            fs.delete(temporary, False)
        return True
    hadoop = jvm.org.apache.hadoop.fs
    context = hadoop.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    no_overwrite = spark.sparkContext._gateway.new_array(getattr(hadoop, "Options$Rename"), 0)
    try:
        context.rename(fs.makeQualified(temporary), fs.makeQualified(p), no_overwrite)
    except Exception:
        fs.delete(temporary, False)
        if fs.exists(p):  # another writer was first
            return False
        raise
    return True


def is_missing_path(exc: Exception) -> bool:
    """True when a read failed because nothing has been written there yet;
    any other failure is not an empty table."""
    return "PATH_NOT_FOUND" in str(exc) or "Path does not exist" in str(exc)


def is_file(spark: SparkSession, path: str) -> bool:
    """True when ``path`` is a single file (not a folder)."""
    fs, p = _hadoop_path(spark, path)
    return fs.exists(p) and fs.getFileStatus(p).isFile()


def ensure_dir(spark: SparkSession, path: str) -> str:
    """Create ``path`` (and parents) if missing, so a file stream can start
    before its first file arrives."""
    fs, p = _hadoop_path(spark, path)
    if not fs.exists(p):
        fs.mkdirs(p)
    return path


def list_dirs(spark: SparkSession, path: str) -> list[str]:
    """Names of the sub-folders of ``path`` (empty when it does not exist)."""
    fs, p = _hadoop_path(spark, path)
    if not fs.exists(p):
        return []
    return [st.getPath().getName() for st in fs.listStatus(p) if st.isDirectory()]


def list_files(spark: SparkSession, path: str) -> list[str]:
    """Names of the files in ``path`` (empty when it does not exist), without
    those still being written."""
    fs, p = _hadoop_path(spark, path)
    if not fs.exists(p):
        return []
    names = [st.getPath().getName() for st in fs.listStatus(p) if st.isFile()]
    return [n for n in names if not n.startswith((".", "_")) and not n.endswith(".tmp")]


def delete_dir(spark: SparkSession, path: str, inside: str) -> bool:
    """Delete folder ``path`` recursively; refuses anything not strictly
    below ``inside``."""
    root = inside.rstrip("/") + "/"
    if not path.startswith(root) or len(path) <= len(root):
        raise ValueError(f"refusing to delete {path!r} outside {inside!r}")
    fs, p = _hadoop_path(spark, path)
    return bool(fs.delete(p, True)) if fs.exists(p) else False
