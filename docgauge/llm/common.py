"""Session helpers shared by the training-data operators."""

from __future__ import annotations

import gc
import tempfile
import uuid
from dataclasses import dataclass

from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of all word rules here, as a Java/RE2 character class body.
SPACE = r"\x20\x09-\x0D"
#: Words as a positive class, which Java matches far faster than the negated one.
WORD = r"[\x00-\x08\x0E-\x1F\x21-\x{10FFFF}]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where the setting is missing (local tests) a temporary folder is used, which is right
    only because a local master runs driver and executors on one machine.
    """
    sc = spark.sparkContext
    told = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    now = sc.getCheckpointDir() if hasattr(sc, "getCheckpointDir") else None
    if told is None and now is None:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        told = "file://" + tempfile.mkdtemp(prefix="docgauge-")
    if now is None:
        sc.setCheckpointDir(told)
    return told or now


def pin(df: DataFrame) -> DataFrame:
    """Compute df once and keep it as a reliable checkpoint, so lost executors don't redo the lineage."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def unsized(df: DataFrame) -> DataFrame:
    """A pinned table of a few numbers a row, without the size that Spark takes it to have.

    A checkpoint keeps its plan's estimate, and a join's is the product of its sides'. In a loop that joins what it made
    before, the estimate's digits double with each join, until the number itself fills the driver.
    """
    session = df.sparkSession
    return DataFrame(session._jsparkSession.createDataFrame(df._jdf.javaRDD(), df._jdf.schema()), session)


def unsent(table: DataFrame) -> DataFrame:
    """A table that grows with the input, for a join: Spark sorts and merges it and never broadcasts it, however small it takes it to be."""
    return table.hint("merge")


def arrow_limits(spark: SparkSession) -> None:
    """Batches of texts for Python workers in bounded bytes, unless the session has its own limits."""
    for key, usual, ours in (("spark.sql.execution.arrow.maxRecordsPerBatch", "10000", "1000"), ("spark.sql.execution.arrow.maxBytesPerBatch", "67108864b", "16777216b")):
        if spark.conf.get(key, usual) == usual:
            spark.conf.set(key, ours)


def sweep(spark: SparkSession) -> None:
    """Have the driver collect its garbage, so that Spark deletes shuffle and checkpoint files nobody can read any more.

    It would else happen when the driver's heap fills up, long after a loop's earlier rounds are of no use.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    trim_native(spark)


def trim_native(spark: SparkSession) -> bool:
    """Have the driver's JVM return what its C allocator holds unused, as memory.release() does for Python workers.

    Spark's hundreds of driver threads leave it scattered, outside the heap. False where the JVM knows no such command.
    """
    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
    try:
        find = jvm.java.lang.Class.forName
        kinds = [find(x) for x in ("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")]
        types, told = gateway.new_array(jvm.java.lang.Class, 4), gateway.new_array(jvm.java.lang.Object, 4)
        for k, kind in enumerate(kinds):
            types[k] = kind
        told[0], told[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        server = jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer()
        find("javax.management.MBeanServer").getMethod("invoke", types).invoke(server, told)
    except Py4JError:
        return False
    return True


def scratch(spark: SparkSession, what: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"


def discard(spark: SparkSession, path: str) -> None:
    """Delete a path in whatever store it is."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def text_of(col: str = "text") -> Column:
    """The whole text, null as empty."""
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def ascii_lower(col: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(col, UPPER, LOWER)


def n_words(col: Column) -> Column:
    """How many runs of non-space characters a text has."""
    return F.regexp_count(col, F.lit(WORD)).cast("long")


def sql_crc32(text: str) -> str:
    """DuckDB SQL for the unsigned CRC-32 of an ASCII string."""
    byte = f"list_transform(string_split({text}, ''), lambda c: ascii(c)::BIGINT)"
    bit = "lambda p, q: xor(p >> 1, 3988292384 * (p & 1))"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {byte}), lambda a, b: list_reduce(list_prepend(xor(a, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), {bit})), 4294967295)"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def input_parts(df: DataFrame) -> int:
    """How many partitions a scan has, as a measure of its size that costs no job."""
    return max(1, df.rdd.getNumPartitions())


def pow2(n: int) -> int:
    return 1 << max(0, int(n) - 1).bit_length()


#: A sketch has 64 bits a row; so many rows at most (about 64 MiB as a broadcast table), so many at least.
MOST_ROWS, LEAST_ROWS = 1 << 21, 1 << 12
#: Bits of a sketch for each of its keys, until MOST_ROWS is reached.
BITS_PER_KEY = 16


@dataclass
class Sketch:
    """A bitmap over 64-bit keys as rows (row, bits). It has all its keys and by chance others."""

    table: DataFrame
    size: int


def _slot(key: Column, size: int) -> tuple[Column, Column]:
    return F.pmod(key, F.lit(size)).cast("int"), F.pmod(F.shiftright(key, 40), F.lit(64)).cast("int")


def sketch(keys: DataFrame, key: Column) -> Sketch:
    """The sketch of a pinned table's keys. It grows with their number up to MOST_ROWS.

    Beyond about 10**8 keys it lets most rows pass; the joins behind it then shuffle them all and stay right.
    """
    size = max(LEAST_ROWS, min(MOST_ROWS, pow2(keys.count() * BITS_PER_KEY // 64)))
    row, bit = _slot(key, size)
    slots = keys.select(row.alias("__row"), bit.alias("__bit")).distinct()
    return Sketch(slots.groupBy("__row").agg(F.sum(F.expr("shiftleft(1L, __bit)")).alias("__bits")), size)


def marked(df: DataFrame, key: Column, found: Sketch, name: str) -> DataFrame:
    """df with a boolean column: false where the key is surely not in the sketch. MOST_ROWS bounds the broadcast."""
    row, bit = _slot(key, found.size)
    out = df.withColumn("__row", row).withColumn("__bit", bit).join(F.broadcast(found.table), "__row", "left")
    hit = F.coalesce(F.expr("(shiftright(__bits, __bit) & 1) = 1"), F.lit(False))
    return out.withColumn(name, hit).drop("__row", "__bit", "__bits")


def packed(docs: DataFrame, *more: Column) -> DataFrame:
    """All columns as one struct doc, and more columns, so that no name of the input can clash with ours."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), *more)


#: Keys that are held to be hot are at most so many.
HOT_KEYS = 10_000


def join_counted(rows: DataFrame, table: DataFrame, key: str, table_key: str, n: str, how: str = "inner") -> DataFrame:
    """rows (pinned) joined with table (pinned), which has one row per key and the number n of its rows.

    A key with more than one in HOT_KEYS of all these rows is hot. There are fewer than HOT_KEYS of them whatever
    the input's size, so their part of the table is broadcast and their rows stay where they are; the
    other keys meet by shuffle, and none of them can fill a task.
    """
    total = table.agg(F.sum(n).alias("t")).first()["t"] or 0
    hot = F.col(n) * F.lit(HOT_KEYS) > F.lit(total)
    on = F.col(key) == F.col(table_key)
    near = rows.join(F.broadcast(table.where(hot)), on)
    names = F.broadcast(table.where(hot).select(F.col(table_key).alias("__hot")))
    far = rows.join(names, F.col(key) == F.col("__hot"), "left_anti").join(table.where(~hot), on, how)
    return near.unionByName(far)


def dealt_join(rows: DataFrame, table: DataFrame, key: str, table_key: str) -> DataFrame:
    """The inner join of rows and table by whole numbers, so planned that Spark can split a hot key at run time.

    Adaptive execution splits a partition only if both sides are dealt out for this very join. A checkpoint
    remembers how it was dealt, and a side that lies right already could not be split; so the keys are
    expressions, of which nobody knows how they lie.
    """
    zero = F.lit(0).cast("long")
    return rows.join(unsent(table), F.col(key).bitwiseXOR(zero) == F.col(table_key).bitwiseXOR(zero))


def drop_rows(docs: DataFrame, keys: list[Column], gone: DataFrame) -> DataFrame:
    """docs without the rows whose keys are in gone (columns k0, k1, ... and once: keep one of such rows).

    Only rows that the sketch of gone marks are shuffled, so the texts of most others stay where they are.
    """
    names, mine = [f"g{i}" for i in range(len(keys))], [f"k{i}" for i in range(len(keys))]
    gone = pin(gone.select(*[F.col(k).alias(n) for k, n in zip(mine, names)], "once"))
    keyed = marked(packed(docs, *[k.alias(n) for k, n in zip(keys, mine)]), F.xxhash64(*mine), sketch(gone, F.xxhash64(*names)), "maybe")
    on = F.lit(True)
    for k, n in zip(mine, names):
        on = on & F.col(k).eqNullSafe(F.col(n))
    met = keyed.where("maybe").join(gone, on, "left")
    out = keyed.where("NOT maybe").select("doc.*").unionByName(met.where("once IS NULL").select("doc.*"))
    if gone.where("once").limit(1).count():
        out = out.unionByName(met.where("once").dropDuplicates(mine).select("doc.*"))
    return out
