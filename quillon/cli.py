"""Command line: cluster a pair-list file, or classify it against saved centroids."""

from __future__ import annotations

import argparse
import logging
import sys
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from quillon import __version__
from quillon.functions.rand import DEFAULT_SEED
from quillon.operators import classify as cl
from quillon.operators import cluster as cs
from quillon.operators import weights as wt
from quillon.plans import clustering
from quillon.sources import tsv


class CommandError(Exception):
    """A message for the user; nothing has been read or written."""


def check_paths(spark: SparkSession, inputs: list[str], outputs: list[str]) -> None:
    """Raises before any work if an input is missing or unreadable, or an output exists or its folder cannot be written."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def opened(name: str) -> tuple:
        path = jvm.org.apache.hadoop.fs.Path(name)
        return path, path.getFileSystem(conf)

    for name in inputs:
        path, fs = opened(name)
        try:
            if not fs.globStatus(path):
                raise CommandError(f"File not found: {name}")
            fs.access(path, jvm.org.apache.hadoop.fs.permission.FsAction.READ)
        except Py4JJavaError as e:
            raise CommandError(f"Cannot read {name}: {e.java_exception.getMessage()}") from None
    for name in outputs:
        path, fs = opened(name)
        probe = jvm.org.apache.hadoop.fs.Path(f"{name}.probe-{uuid.uuid4().hex}")
        try:
            if fs.exists(path):
                raise CommandError(f"Output exists: {name}")
            fs.create(probe).close()
            fs.delete(probe, False)
        except Py4JJavaError as e:
            raise CommandError(f"Cannot write {name}: {e.java_exception.getMessage()}") from None


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="quillon", description=__doc__)
    p.add_argument("file", help="documents: name TAB feature TAB value ...")
    p.add_argument("output", help="folder for the result lines")
    p.add_argument("-n", "--number", type=int, help="number of clusters (wins over --limit)")
    p.add_argument("-l", "--limit", type=float, help="smallest gain of a bisection")
    p.add_argument("-p", "--point", action="store_true", help="write similarities beside members")
    p.add_argument("-c", "--clvector", help="folder for the centroids")
    p.add_argument("--clvector-size", type=int, default=50)
    p.add_argument("--method", choices=["rb", "kmeans"], default="rb")
    p.add_argument("--seed", type=int, default=DEFAULT_SEED)
    p.add_argument("-C", "--classify", help="centroid file; wins over -n and -l")
    p.add_argument("--inv-keys", type=int, default=cl.INV_KEYS)
    p.add_argument("--inv-size", type=int, default=cl.INV_SIZE)
    p.add_argument("--classify-size", type=int, default=cl.CLASSIFY_SIZE)
    p.add_argument("--vector-size", type=int, help="features kept of each document")
    p.add_argument("--idf", action="store_true")
    p.add_argument("--debug", action="store_true", help="log every split of a bisection")
    p.add_argument("-v", "--version", action="version", version=__version__)
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    if not args.classify and args.number is None and args.limit is None:
        parser().error("give -n, -l or -C")
    spark = spark or SparkSession.builder.appName("quillon").getOrCreate()
    if args.debug:
        logging.basicConfig()
        clustering.LOG.setLevel(logging.DEBUG)
    try:
        check_paths(spark, [args.file, *([args.classify] if args.classify else [])], [args.output, *([args.clvector] if args.clvector and not args.classify else [])])
    except CommandError as e:
        print(f"[ERROR] {e}", file=sys.stderr)
        return 1
    docs, features = tsv.read_vectors(spark, args.file, skip_empty=not args.classify)
    if args.idf:
        features = wt.idf(features, docs.count())
    if args.vector_size:
        features = wt.heaviest(features, args.vector_size).select("ord", "feature", "value")
    u = clustering.cut(cs.unit(features))
    if args.classify:
        names, vectors = tsv.read_vectors(spark, args.classify)
        raw = names.join(vectors, "ord").select(F.col("ord").alias("cent_ord"), F.col("doc_id").alias("cluster"), "feature", "value")
        found = cl.classify(u, cl.make_centroids(raw), args.inv_keys, args.inv_size, args.classify_size)
        tsv.write_lines(tsv.classified_lines(docs, found), args.output, "ord")
        return 0
    assign = clustering.cut(clustering.cluster(u, docs, args.method, args.number, None if args.number else args.limit, args.seed))
    tsv.write_lines(tsv.cluster_lines(cs.points(u, assign, docs), args.point), args.output, "cluster_id")
    if args.clvector:
        tsv.write_lines(tsv.centroid_lines(cs.centroid_top(cs.centroid(cs.composite(u, assign)), features, args.clvector_size)), args.clvector, "cluster_id")
    return 0


if __name__ == "__main__":
    sys.exit(main())
