"""Secret scans: three exact patterns, and a randomness test battery for everything else.

Candidates are maximal runs of at least 20 characters of ``[A-Za-z0-9+/_=-]`` that overlap no
pattern match. For each, the encoding is inferred (hex, base32, base64) and three statistics
are computed over its alphabet of k symbols: chi-squared uniformity, Wald-Wolfowitz runs
about the middle of the alphabet, and lag-1 serial correlation. Each gives a p-value against
ordinary runs of text:

- uniformity, base64: the chance that running text of its length would look as uniform (the
  chi-squared statistic against its expectation under the letter coincidence rate of text).
  Sixteen or 32 symbols are about as uneven in text as in a key, so for hex and base32 the null
  is an ordinary run with letters as frequent as in text and any share of digits: its likelihood
  over that of uniform symbols bounds the chance of a run that keeps as well to the alphabet
  (Markov's inequality).
- runs and serial correlation: the chance that an ordinary run comes as close to what random
  symbols show. The null is normal, with the mean and spread of the statistic over all candidates
  of the corpus of this encoding and stratum of length.

The three combine by Stouffer's method with the weights ``WEIGHTS``. Benjamini-Hochberg control
at rate Q runs within strata of length, because the power of the tests depends on length. A
discovery must also not be rejected as random: runs and serial correlation, in hex and base32
chi-squared too, lie within ``BOUND`` standard deviations. P-values are kept in bins of 1/20 of
a decade, rounded towards 1, so the control needs only the counts of a few thousand bins,
whatever the number of candidates.

Everything is a DataFrame expression and linear in the text (apart from sorting its spans):
spans of patterns and runs are merged in order of place, and a run is tested piece by piece.
Positions count code points, ends are exclusive.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm.common import ids_and_text, let, prefix_scan, stage

# The three patterns, the shortest lengths, and the kinds in their order.
ASSIGN = r"([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = r"AKIA[A-Z0-9]{16,}"  # a run is matched whole or not at all, as with + and a length check
HEX = r"[0-9a-f]{24,}"
RUN = r"[A-Za-z0-9+/_=-]{20,}"
KINDS = ["assign", "access", "hex", "random"]
#: Longest lengths of the strata but the last.
STRATA = (23, 31, 47, 95)
#: Coincidence rate of letters in running text; false-discovery rate; two-sided normal bound of the other tests.
COINCIDENCE, Q, BOUND = 0.065, 0.01, 3.0
#: Weights of the uniformity, runs and serial tests (the latter two say little about 20 symbols); a deviate of any test counts up to MOST.
WEIGHTS, MOST = (6.0, 1.0, 1.0), 37.0
#: Symbols of a run tested at once, which bounds the memory of very long runs.
PIECE = 4096
BINS_PER_DECADE, MOST_BINS = 20, 600
#: Letters a to z in running text, per 10,000 (mean of English, German, French and Spanish).
LETTERS = (846, 162, 320, 450, 1400, 141, 191, 308, 682, 43, 57, 447, 277, 758, 615, 191, 59, 664, 738, 677, 404, 120, 109, 21, 93, 50)
_SPANS = "array<struct<start:long,kind:int,end:long,hit:string>>"
RANDOM = 3  # kind


def match_spans(text: Column, pattern: str, kind: int, group: int = 0, least: int = 0, keep: bool = False) -> Column:
    """(start, kind, end, hit) of the leftmost non-overlapping matches whose group has ``least`` characters; hit is the match if asked for.

    A split at the pattern gives the texts between the matches, so running totals of both
    lengths give the places. Texts without a match skip all that.
    """
    none = F.array().cast(_SPANS)
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    checked = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found

    def places(gaps: Column, hits: Column, value: Column) -> Column:
        before = F.zip_with(F.slice(gaps, 1, F.size(hits)), hits, lambda g, m: F.struct(F.length(g).cast("long").alias("g"), F.length(m).cast("long").alias("m")))
        hit = lambda i: F.get(hits, i) if keep else F.lit(None).cast("string")
        return let(before, lambda b: let(prefix_scan(F.transform(b, lambda x: x["g"] + x["m"])), lambda ends: F.transform(ends, lambda e, i: F.struct((e - F.get(b, i)["m"]).alias("start"), F.lit(kind).alias("kind"), e.alias("end"), hit(i).alias("hit"), F.length(F.get(value, i)).alias("size")))))

    spans = let(F.split(text, pattern, -1), lambda gaps: let(found, lambda hits: let(checked, lambda value: places(gaps, hits, value))))
    kept = F.transform(F.filter(spans, lambda s: s["size"] >= least), lambda s: F.struct(s["start"], s["kind"], s["end"], s["hit"]).cast(_SPANS[6:-1]))
    return F.when(text.rlike(pattern), kept).otherwise(none)


def free_runs(base: Column, runs: Column) -> Column:
    """The runs (disjoint among themselves) that overlap no span of base, by one pass over both in order of place.

    A run overlaps an earlier span if the largest end so far lies beyond its start, and a later
    one if the next in order is a span of base (not a run) that begins before its end.
    """

    def sweep(s: Column) -> Column:
        ends = prefix_scan(F.transform(s, lambda x: F.when(x["kind"] == RANDOM, F.lit(-1).cast("long")).otherwise(x["end"])), lambda a, b: F.greatest(a, b), -1)
        hidden = lambda x, i, e: (F.coalesce(F.get(e, i - 1), F.lit(-1)) > x["start"]) | F.coalesce((F.get(s, i + 1)["kind"] != RANDOM) & (F.get(s, i + 1)["start"] < x["end"]), F.lit(False))
        return let(ends, lambda e: F.filter(F.transform(s, lambda x, i: F.when((x["kind"] == RANDOM) & ~hidden(x, i, e), x)), lambda x: x.isNotNull()))

    return F.when(F.size(runs) == 0, F.array().cast(_SPANS)).when(F.size(base) == 0, runs).otherwise(let(F.array_sort(F.concat(base, runs)), sweep))


def normal_tail(z: Column) -> Column:
    """P(Z > z) for z >= 0 by a rational approximation with an absolute error below 1e-7 (relative: far tails by Mills' ratio)."""
    t = F.lit(1.0) / (F.lit(1.0) + F.lit(0.2316419) * z)
    poly = t * (F.lit(0.319381530) + t * (F.lit(-0.356563782) + t * (F.lit(1.781477937) + t * (F.lit(-1.821255978) + t * F.lit(1.330274429)))))
    density = F.exp(-z * z / 2) / F.lit(2.5066282746310002)
    return F.when(z > 5, density * z / (z * z + 1)).otherwise(density * poly)


def deviate_of(p: Column) -> Column:
    """z with P(Z > z) = p, for p in (0, 1), to 5e-4, by a rational approximation."""
    above = lambda t: t - (F.lit(2.515517) + t * (F.lit(0.802853) + t * F.lit(0.010328))) / (F.lit(1.0) + t * (F.lit(1.432788) + t * (F.lit(0.189269) + t * F.lit(0.001308))))
    tail = lambda q: let(F.sqrt(-2 * F.log(F.greatest(F.lit(1e-300), F.least(q, 1 - q)))), above)
    return let(p, lambda q: F.when(q <= 0.5, F.lit(1.0)).otherwise(F.lit(-1.0)) * tail(q))


def ordinary(counts: Column, n: Column, size: Column) -> Column:
    """log10 of the likelihood of symbol counts as those of an ordinary run, over that of uniform symbols; null in base64.

    Letters are as frequent as in text, digits alike, and their shares those of the run, which
    suits it best; so words, numbers and serial numbers all come out above 0.
    """
    by_letter = [math.log10(c / sum(LETTERS)) for c in LETTERS]
    share = lambda m: F.when(m > 0, m * F.log10(m / n)).otherwise(0.0)

    def total(place: Column) -> Column:
        """place: the log-likelihood of each symbol within letters or digits, and whether it is a letter."""
        drawn = F.aggregate(F.zip_with(counts, place, lambda c, p: c * p["by"]), F.lit(0.0), lambda t, x: t + x)
        letters = F.aggregate(F.zip_with(counts, place, lambda c, p: c * p["letter"]), F.lit(0.0), lambda t, x: t + x)
        return let(letters, lambda m: drawn + share(m) + share(n - m) + n * F.log10(size.cast("double")))

    letter = lambda v: F.struct(F.lit(v).alias("by"), F.lit(1.0).alias("letter"))
    digit = F.struct(F.lit(-1.0).alias("by"), F.lit(0.0).alias("letter"))
    in16 = F.array(*[digit] * 10, *[letter(v) for v in by_letter[:6]])
    in32 = F.array(*[letter(v) for v in by_letter], *[digit] * 6)
    return F.when(size == 16, total(in16)).when(size == 32, total(in32))


def battery(token: Column) -> Column:
    """k (alphabet size), n, chi (chi-squared), runs and serial (normal deviates) and ordinary (log10, hex and base32 only) of a string.

    Padding is no symbol; in base64 the code of a symbol is its place in A-Z a-z 0-9 + /, with
    - and _ for + and /.
    """
    bare = F.replace(token, F.lit("="), F.lit(""))
    k = lambda t: F.when(t.rlike("^([0-9a-f]+|[0-9A-F]+)$"), F.lit(16)).when(t.rlike("^[A-Z2-7]+$"), F.lit(32)).otherwise(F.lit(64))
    by_size = {16: "0123456789abcdef", 32: "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 64: "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"}
    alphabet = lambda size: F.when(size == 16, by_size[16]).when(size == 32, by_size[32]).otherwise(by_size[64])
    plain = lambda t, size: F.when(size == 16, F.lower(t)).when(size == 64, F.translate(t, "-_", "+/")).otherwise(t)

    def tests(t: Column, size: Column, symbols: Column) -> Column:
        n = F.length(t).cast("double")
        counts = F.transform(F.split(symbols, ""), lambda c: (F.length(t) - F.length(F.replace(t, c, F.lit("")))).cast("double"))
        empty = F.struct(F.lit(-1).alias("first"), F.lit(-1).alias("last"), F.lit(0.0).alias("lag"), F.lit(0.0).alias("changes"))

        def step(s: Column, c: Column) -> Column:
            v = F.instr(symbols, c) - 1
            seen, before = s["last"] >= 0, s["last"]
            lag = s["lag"] + F.when(seen, (before * v).cast("double")).otherwise(0.0)
            changes = s["changes"] + F.when(seen & ((before * 2 >= size) != (v * 2 >= size)), 1.0).otherwise(0.0)
            return F.struct(F.when(seen, s["first"]).otherwise(v).alias("first"), v.alias("last"), lag.alias("lag"), changes.alias("changes"))

        pieces = F.regexp_extract_all(t, F.lit(f".{{1,{PIECE}}}"), F.lit(0))
        scan = F.aggregate(pieces, empty, lambda s, piece: F.aggregate(F.split(piece, ""), s, step))
        total = lambda xs: F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)

        def deviates(cs: Column, walk: Column) -> Column:
            squares = total(F.transform(cs, lambda c: c * c))
            high = total(F.transform(cs, lambda c, i: F.when(i * 2 >= size, c).otherwise(0.0)))
            mean = total(F.transform(cs, lambda c, i: c * i)) / n
            square = total(F.transform(cs, lambda c, i: c * i * i))

            def last(q: Column, h: Column, m: Column, sq: Column) -> Column:
                spread = sq - n * m * m
                lagged = walk["lag"] - m * (2 * n * m - walk["first"] - walk["last"]) + (n - 1) * m * m
                expected = F.lit(1.0) + 2 * h * (n - h) / n
                variance = (expected - 1) * (expected - 2) / (n - 1)
                runs = F.when(variance > 0, (walk["changes"] + 1 - expected) / F.sqrt(variance)).otherwise(F.lit(99.0))
                serial = F.when(spread > 1e-9, (lagged / spread + F.lit(1.0) / n) * F.sqrt(n)).otherwise(F.lit(99.0))
                return F.struct(size.alias("k"), n.alias("n"), (size / n * q - n).alias("chi"), runs.alias("runs"), serial.alias("serial"), ordinary(cs, n, size).alias("ordinary"))

            return let(squares, lambda q: let(high, lambda h: let(mean, lambda m: let(square, lambda sq: last(q, h, m, sq)))))

        return F.when(n >= 16, let(counts, lambda cs: let(scan, lambda walk: deviates(cs, walk))))

    return let(bare, lambda t: let(k(t), lambda size: let(plain(t, size), lambda p: let(alphabet(size), lambda symbols: tests(p, size, symbols)))))


def text_deviate(t: Column) -> Column:
    """How many standard deviations the chi-squared statistic lies below that of running text of this length."""
    excess = (t["n"] - 1) * (t["k"] * F.lit(COINCIDENCE) - 1)
    return (excess + t["k"] - 1 - t["chi"]) / F.sqrt(2 * (t["k"] - 1) + 4 * excess)


def held(z: Column) -> Column:
    return F.greatest(F.lit(-MOST), F.least(F.lit(MOST), z))


def uniformity(t: Column) -> Column:
    """Normal deviate of the uniformity test against ordinary runs, at most MOST."""
    tenfold = F.least(F.lit(0.0), t["ordinary"])
    bounded = F.when(tenfold < -290, F.lit(36.0)).otherwise(deviate_of(F.pow(F.lit(10.0), tenfold)))
    return held(F.when(t["k"] < 64, F.when(t["ordinary"] >= 0, F.lit(-MOST)).otherwise(bounded)).otherwise(text_deviate(t)))


def closeness(z: Column, mean: Column, sd: Column) -> Column:
    """Normal deviate of how close to 0 a statistic comes, against a null of this mean and spread."""
    below = lambda v: let(v, lambda x: let(normal_tail(F.abs(x)), lambda q: F.when(x >= 0, 1 - q).otherwise(q)))
    p = lambda size: below((size - mean) / sd) - below((-size - mean) / sd)
    return let(F.abs(z), lambda size: held(deviate_of(F.greatest(F.lit(1e-12), F.least(F.lit(1 - 1e-12), p(size))))))


def like_random(t: Column) -> Column:
    """Whether the tests that gave no p-value are passed; chi-squared by its cube root, which is nearly normal."""
    spread = F.lit(2.0) / (9 * (t["k"] - 1))
    uneven = (F.pow(t["chi"] / (t["k"] - 1), F.lit(1 / 3)) - 1 + spread) / F.sqrt(spread)
    return (F.abs(t["runs"]) <= BOUND) & (F.abs(t["serial"]) <= BOUND) & ((t["k"] == 64) | (uneven <= BOUND))


def stratum(n: Column) -> Column:
    out = F.lit(len(STRATA))
    for i, top in reversed(list(enumerate(STRATA))):
        out = F.when(n <= top, F.lit(i)).otherwise(out)
    return out


def find_candidates(docs: DataFrame) -> DataFrame:
    """doc_id, base (spans of the patterns) and candidates (tested runs), one row per document."""
    texts = ids_and_text(docs)
    text = F.col("text")
    base = texts.select("doc_id", F.array_sort(F.concat(match_spans(text, ASSIGN, 0, 2, 6), match_spans(text, ACCESS, 1), match_spans(text, HEX, 2))).alias("base"), match_spans(text, RUN, RANDOM, keep=True).alias("runs"))
    about = lambda r, t: F.struct(r["start"].alias("start"), r["end"].alias("end"), t["k"].alias("k"), stratum(t["n"]).alias("stratum"), uniformity(t).alias("uniform"), t["runs"].alias("runs"), t["serial"].alias("serial"), like_random(t).alias("like"))
    tested = F.transform(free_runs(F.col("base"), F.col("runs")), lambda r: let(battery(r["hit"]), lambda t: F.when(t.isNotNull(), about(r, t))))
    return base.select("doc_id", F.transform("base", lambda s: F.struct(s["start"], s["kind"], s["end"])).alias("base"), F.filter(tested, lambda c: c.isNotNull()).alias("candidates"))


def null_moments(found: DataFrame) -> Column:
    """Map from encoding and stratum (k * 10 + stratum) to mean and spread of the runs and serial deviates over all candidates.

    At most 3 * (len(STRATA) + 1) entries.
    """
    grouped = found.select(F.explode("candidates").alias("c")).groupBy("c.k", "c.stratum")
    rows = grouped.agg(*[f(held(F.col(f"c.{c}"))).alias(f"{c}_{n}") for c in ("runs", "serial") for n, f in (("mean", F.avg), ("sd", F.stddev_pop))]).collect()
    entries = [(r["k"] * 10 + r["stratum"], (r["runs_mean"], max(1.0, r["runs_sd"]), r["serial_mean"], max(1.0, r["serial_sd"]))) for r in rows] or [(-1, (0.0, 1.0, 0.0, 1.0))]
    return F.create_map(*[x for key, m in sorted(entries) for x in (F.lit(key), F.array(*map(F.lit, m)))])


def p_bin(c: Column, moments: Column) -> Column:
    """Bin of -log10 of a candidate's combined p-value, rounded down (p towards 1)."""
    total = lambda m: WEIGHTS[0] * c["uniform"] + WEIGHTS[1] * closeness(c["runs"], F.get(m, 0), F.get(m, 1)) + WEIGHTS[2] * closeness(c["serial"], F.get(m, 2), F.get(m, 3))
    combined = let(F.try_element_at(moments, c["k"] * 10 + c["stratum"]), lambda m: total(m) / F.lit(math.sqrt(sum(w * w for w in WEIGHTS))))
    p = let(combined, lambda z: F.when(z <= 0, F.lit(1.0)).otherwise(F.greatest(normal_tail(z), F.lit(1e-300))))
    return F.least(F.lit(MOST_BINS), F.floor(-F.log10(p) * BINS_PER_DECADE)).cast("int")


def discovery_bins(found: DataFrame, q: float = Q) -> dict[int, int]:
    """By stratum, the smallest bin that Benjamini-Hochberg control at rate q accepts (at most len(STRATA) + 1 rows)."""
    counts = found.select(F.explode("candidates").alias("c")).groupBy(F.col("c.stratum").alias("stratum"), F.col("c.bin").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    down = Window.partitionBy("stratum").orderBy(F.desc("bin"))  # over at most MOST_BINS + 1 rows of counts each
    ranked = counts.withColumn("rank", F.sum("n").over(down)).withColumn("all", F.sum("n").over(Window.partitionBy("stratum")))
    p = F.pow(F.lit(10.0), -F.col("bin") / F.lit(float(BINS_PER_DECADE)))
    accepted = ranked.filter((F.col("bin") > 0) & (p <= F.lit(q) * F.col("rank") / F.col("all")))
    return {r["stratum"]: r["least"] for r in accepted.groupBy("stratum").agg(F.min("bin").alias("least")).collect()}


def find_secrets(docs: DataFrame, q: float = Q) -> DataFrame:
    """doc_id, base and spans: sorted arrays of (start, kind, end), kind an index into KINDS.

    One row per input row (repeated rows and null doc_ids included); null and empty texts have
    no spans; extra columns are ignored; an empty table gives an empty result.
    """
    tested = stage(find_candidates(docs), "secrets")
    moments = null_moments(tested)
    rated = F.transform("candidates", lambda c: F.struct(c["start"], c["end"], c["stratum"], c["like"], p_bin(c, moments).alias("bin")))
    found = stage(tested.select("doc_id", "base", rated.alias("candidates")), "rated")
    bins = discovery_bins(found, q)
    threshold = lambda c: F.coalesce(*[F.when(c["stratum"] == s, c["bin"] >= least) for s, least in bins.items()], F.lit(False))
    added = F.transform(F.filter("candidates", lambda c: c["like"] & threshold(c)), lambda c: F.struct(c["start"], F.lit(RANDOM).alias("kind"), c["end"]))
    return found.select("doc_id", "base", F.array_sort(F.concat("base", added)).alias("spans"))


def written(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")
