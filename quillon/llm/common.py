"""Helpers shared by the operators: shared storage, lineage cuts and table reading."""

from __future__ import annotations

import atexit
import ctypes
import gc
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table, read by Spark so that any store it can open works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Only where that is unset and the master is local (tests, a laptop) a temporary folder takes
    its place; on a cluster the executors would not see it, so that is an error.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(named)
        return named
    if sc.getCheckpointDir() is None:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="quillon-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Materialise a small or iterated frame in the shared folder and forget its lineage."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # noqa: BLE001  the session may be gone at interpreter exit
        pass


def remove_at_exit(spark: SparkSession, path: str) -> None:
    atexit.register(_remove, spark, path)


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write a frame as compact Parquet into the shared folder and read it back.

    Survives lost executors, costs no recomputation, and is removed when the driver exits.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/stage-{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    remove_at_exit(spark, path)
    return spark.read.schema(df.schema).parquet(path)


#: Keys of a join count as hot from this many rows on, and from this share of all rows on, so that few are hot.
HOT_ROWS, HOT_SHARE = 100, 100_000


def join_hot(rows: DataFrame, keyed: DataFrame, keys: list[str], total: int) -> DataFrame:
    """rows joined with a frame of one row per key, whose column n (left out) counts the key's rows, ``total`` in all.

    Rows of hot keys meet their side by broadcast and are spread over the shuffle by a hash of
    the whole row: at most ``HOT_SHARE`` keys can have more than a share of 1 / HOT_SHARE of the
    rows, so their side is small, whatever the input. Null keys match nothing.
    """
    bound = max(HOT_ROWS, total // HOT_SHARE)
    others = [c for c in keyed.columns if c not in (*keys, "n")]
    side = keyed.select(*[F.col(k).alias(f"__{k}") for k in keys], F.struct(F.lit(True).alias("__met"), *others).alias("__cold"), F.col("n").alias("__n"))
    hot = cut(side.filter(F.col("__n") > bound).drop("__n").withColumnRenamed("__cold", "__hot"))
    if hot.isEmpty():
        joined = rows.join(side.drop("__n"), [rows[k] == F.col(f"__{k}") for k in keys])
        return joined.select(*rows.columns, *[F.col("__cold")[c].alias(c) for c in others])
    marked = rows.join(F.broadcast(hot), [rows[k] == F.col(f"__{k}") for k in keys], "left").drop(*[f"__{k}" for k in keys])
    first = F.when(F.col("__hot").isNotNull(), F.xxhash64(*rows.columns)).otherwise(F.col(keys[0]))
    cold = side.filter(F.col("__n") <= bound).drop("__n")
    joined = marked.withColumn("__first", first).join(cold, [F.col("__first") == F.col(f"__{keys[0]}"), *[F.col(k) == F.col(f"__{k}") for k in keys[1:]]], "left")
    met = F.coalesce("__hot", "__cold")
    return joined.filter(met.isNotNull()).select(*rows.columns, *[met[c].alias(c) for c in others])


def ids_and_text(docs: DataFrame) -> DataFrame:
    """doc_id and text only (null text: empty), so that other columns can clash with nothing."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def draw_labels(labels: DataFrame, name: str, sample: int, seed: int) -> DataFrame:
    """l_id and the label ``name`` (0 or 1) of at most ``sample`` documents, by hash of their id.

    Repeated labels count once; a document whose labels contradict each other is left out, and so
    are null ids and labels other than 0 and 1. Only hashes below a threshold for about
    ``sample`` rows are sorted, so what a task hands on does not grow with the table.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("l_id"), F.col(name).cast("int").alias(name)).filter(F.col("l_id").isNotNull() & F.col(name).isin(0, 1))
    single = known.groupBy("l_id").agg(F.min(name).alias("least"), F.max(name).alias(name)).filter(F.col("least") == F.col(name)).select("l_id", name, F.xxhash64("l_id", F.lit(seed)).alias("h"))
    share = min(1.0, sample / max(1, single.count()))
    near = single if share == 1.0 else single.filter(F.col("h") < F.lit(int((2 * share - 1) * ((1 << 63) - 1024))))
    return near.orderBy("h", "l_id").limit(sample).select("l_id", name)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body refers to it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def prefix_scan(values: Column, combine: Callable[[Column, Column], Column] = lambda t, x: t + x, start: int = 0, chunk: int = 64) -> Column:
    """Running totals (inclusive) of an array of longs under an associative function, in three levels to stay near linear."""

    def running(xs: Column, begin: Column) -> Column:
        step = lambda s, x: F.struct(combine(s["t"], x).alias("t"), F.concat(s["a"], F.array(combine(s["t"], x))).alias("a"))
        return F.aggregate(xs, F.struct(begin.alias("t"), F.array().cast("array<long>").alias("a")), step, lambda s: s["a"])

    def level(xs: Column, inner: Callable[[Column], Column]) -> Column:
        """Totals of chunks, scanned by ``inner``, start the scans inside the chunks."""
        chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / F.lit(chunk)).cast("int")), lambda c: F.slice(xs, c * chunk + 1, F.lit(chunk)))
        total = lambda ch: F.aggregate(ch, zero, combine)
        return let(chunks, lambda cs: let(inner(F.transform(cs, total)), lambda ends: F.flatten(F.transform(cs, lambda ch, i: running(ch, F.coalesce(F.get(ends, i - 1), zero))))))

    zero = F.lit(start).cast("long")
    flat = lambda xs: running(xs, zero)
    scanned = lambda xs: F.when(F.size(xs) <= chunk, flat(xs)).otherwise(level(xs, lambda ts: F.when(F.size(ts) <= chunk, flat(ts)).otherwise(level(ts, flat))))
    return let(values, lambda xs: F.when(F.size(xs) == 0, F.array().cast("array<long>")).otherwise(scanned(xs)))


def trimmed(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """The same batch function; its worker gives freed memory back to the system when a task ends.

    Workers are reused, so what a task leaves allocated would otherwise stay for later stages.
    """

    def with_release(batches: Iterator) -> Iterator:
        import pyarrow as pa

        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except (AttributeError, OSError):
                pass

    return with_release
