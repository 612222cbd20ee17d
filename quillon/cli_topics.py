"""Command line of the topic models: memberships of the documents of a pair-list file."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from quillon import __version__
from quillon.cli import CommandError, check_paths
from quillon.functions.rand import DEFAULT_SEED
from quillon.operators import weights as wt
from quillon.plans import topics
from quillon.sources import tsv


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="quillon-topics", description=__doc__)
    p.add_argument("--version", action="version", version=__version__)
    models = p.add_subparsers(dest="model", required=True)
    for name, iterations in (("plsi", topics.EM_ITERATIONS), ("lda", topics.GIBBS_ITERATIONS)):
        m = models.add_parser(name)
        m.add_argument("file", help="documents: name TAB feature TAB value ...")
        m.add_argument("output", help="folder for a line per document: name and a number per topic")
        m.add_argument("-n", "--number", type=int, required=True, help="number of topics")
        m.add_argument("-i", "--iter", type=int, default=iterations, help=f"iterations (default {iterations})")
        m.add_argument("--seed", type=int, default=DEFAULT_SEED)
    plsi, lda = models.choices["plsi"], models.choices["lda"]
    plsi.add_argument("-b", "--beta", type=float, default=topics.BETA, help="exponent of tempered EM")
    plsi.add_argument("--normalize", action="store_true", help="memberships that sum to 1")
    lda.add_argument("-a", "--alpha", type=float, help="prior of topics (default 50 / number)")
    lda.add_argument("-b", "--beta", type=float, default=topics.LDA_BETA, help="prior of words")
    lda.add_argument("--phi", help="folder for a line per topic: all words and their shares")
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    if args.number < 1 or args.iter < 0:
        parser().error("the number of topics must be positive, that of iterations not negative")
    spark = spark or SparkSession.builder.appName("quillon-topics").getOrCreate()
    phi = getattr(args, "phi", None)
    try:
        check_paths(spark, [args.file], [args.output, *([phi] if phi else [])])
    except CommandError as e:
        print(f"[ERROR] {e}", file=sys.stderr)
        return 1
    docs, features = tsv.read_vectors(spark, args.file)
    if args.model == "plsi":
        pdz, _, pz = topics.plsi(features, args.number, args.iter, args.beta, args.seed, docs)
        tsv.write_lines(tsv.membership_lines(docs, topics.plsi_membership(pdz, pz, args.normalize)), args.output, "ord")
        return 0
    tokens = topics.gibbs(topics.lda_tokens(features, args.number, args.seed), args.number, args.iter, args.alpha, args.beta, args.seed)
    tsv.write_lines(tsv.theta_lines(docs, topics.theta(tokens, args.number, args.alpha, docs)), args.output, "ord")
    if phi:
        tsv.write_lines(tsv.phi_lines(topics.phi(tokens, args.number, args.beta), wt.firsts(features)), phi, "topic")
    return 0


if __name__ == "__main__":
    sys.exit(main())
