"""Helpers shared by the training-data operators: tables, words, durable intermediates."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of every operator here: space and U+0009 to U+000D, also what bytes.split() splits at.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
#: bytes.translate table that lower-cases A-Z; bytes of other code points stay.
LOWER_BYTES = bytes(range(256)).replace(UPPER.encode(), LOWER.encode())
_U64 = np.uint64
#: Bounds what crosses to Python at once by bytes: an Arrow batch is held there and in the JVM.
SMALL_BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": "4m"}


def let(value: Column, use) -> Column:
    """use(value), with value computed once a row: it is the variable of a lambda, which no plan writes out again."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, lengthened until no column of df has them."""
    held, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in held:
            n += "_"
        held.add(n.lower())
        out.append(n)
    return out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_az(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def words_of(text: Column) -> Column:
    """Array of a text's words; null gives an empty array."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def binary_column(batch, name: str) -> list[bytes | None]:
    """A string column of an Arrow batch as UTF-8 bytes, without decoding."""
    import pyarrow as pa

    col = batch.column(batch.schema.get_field_index(name))
    return col.cast(pa.large_binary() if pa.types.is_large_string(col.type) else pa.binary()).to_pylist()


def shared_folder(spark: SparkSession) -> str:
    """A new folder that the driver and all executors share.

    It lies in spark.checkpoint.dir. Only a local session, which has no other
    machines, may go without that setting; it gets a temporary folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or _context_checkpoint_dir(spark)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="corpuswright-")
        spark.sparkContext.setCheckpointDir(base)
    path = f"{base.rstrip('/')}/corpuswright-{uuid.uuid4().hex}"
    for made in _made:
        made.append(path)
    return path


#: Lists of the folders made within each open temporary().
_made: list[list[str]] = []


@contextmanager
def temporary(spark: SparkSession):
    """Drops the shared folders that are made inside, at the end: what is to stay must be written elsewhere by then."""
    _made.append(own := [])
    try:
        yield
    finally:
        _made.remove(own)
        for path in own:
            drop_folder(spark, path)


def _context_checkpoint_dir(spark: SparkSession) -> str | None:
    found = spark.sparkContext._jsc.sc().getCheckpointDir()
    return found.get() if found.isDefined() else None


def durable(df: DataFrame) -> DataFrame:
    """The rows, written to the shared checkpoint folder: lineage is cut and no executor's loss costs them."""
    spark = df.sparkSession
    if _context_checkpoint_dir(spark) is None:
        base = spark.conf.get("spark.checkpoint.dir", None)
        spark.sparkContext.setCheckpointDir(base) if base else shared_folder(spark)
    return df.checkpoint(eager=True)


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]):
    """The session's settings as given; at the end they are what they were."""
    were = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in were.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def drop_folder(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def taken(sent):
    """A broadcast's value, read anew from its file each time, so that a worker holds one at a time."""
    value = sent.value
    if getattr(sent, "_path", None):
        sent.__dict__.pop("_value", None)
    return value


def give_back() -> None:
    """Returns freed memory to the system: a reused worker would else keep each stage's peak through all later ones."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)


def give_back_heap(spark: SparkSession) -> None:
    """Returns the driver's heap beyond its least free share to the system, and freed native memory.

    What results leave when they pass through would else have the heap grow to its limit
    and stay there. For that one collection, the most free share (a setting that a running
    JVM may change) is the least one. The collection also frees what Spark keeps of
    shuffles and plans that are gone.
    """
    jvm = spark.sparkContext._jvm
    options = jvm.java.lang.management.ManagementFactory.getPlatformMXBean(jvm.java.lang.Class.forName("com.sun.management.HotSpotDiagnosticMXBean"))
    most = options.getVMOption("MaxHeapFreeRatio").getValue()
    options.setVMOption("MaxHeapFreeRatio", options.getVMOption("MinHeapFreeRatio").getValue())
    try:
        jvm.System.gc()
    finally:
        options.setVMOption("MaxHeapFreeRatio", most)
    trim_native(spark)


def trim_native(spark: SparkSession) -> bool:
    """Has the driver's JVM return its C library's freed memory, which its compiler leaves; False if it has no such command."""
    from py4j.protocol import Py4JJavaError

    jvm, new_array = spark.sparkContext._jvm, spark.sparkContext._gateway.new_array
    kind = jvm.java.lang.Class.forName

    def array(of, values):
        out = new_array(of, len(values))
        for i, x in enumerate(values):
            out[i] = x
        return out

    # the server's class isn't public, its interface is
    types = ("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")
    invoke = kind("javax.management.MBeanServer").getMethod("invoke", array(jvm.java.lang.Class, [kind(x) for x in types]))
    name = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand")
    try:
        invoke.invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), array(jvm.java.lang.Object, [name, "systemTrimNativeHeap", None, None]))
    except Py4JJavaError:
        return False
    return True


def frugal(run):
    """run, a function of batches, that gives freed memory back when a task begins and when it is over."""

    def wrapped(batches):
        give_back()
        yield from run(batches)
        give_back()

    return wrapped


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (the published splitmix64 constants), vectorised."""
    with np.errstate(over="ignore"):
        x = x.astype(np.uint64, copy=True)
        x ^= x >> _U64(30)
        x *= _U64(0xBF58476D1CE4E5B9)
        x ^= x >> _U64(27)
        x *= _U64(0x94D049BB133111EB)
        x ^= x >> _U64(31)
    return x


class WordHashes(dict):
    """Words' XXH64 (seed 42), remembered; forgets all beyond `most` so that memory stays bounded."""

    def __init__(self, most: int = 250_000):
        super().__init__()
        import xxhash

        self._hash, self._most = xxhash.xxh64_intdigest, most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self._most:
            self.clear()
        self[word] = h = self._hash(word, 42)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))
