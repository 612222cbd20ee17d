"""MinHash near-duplicate detection.

A document's set is its distinct word n-grams (words: runs without ASCII white space; A-Z
lower-cased). Sets are held as 64-bit hashes of their n-grams; documents of equal sets are
linked at once through a 128-bit hash of the set and its size, and only the smallest doc_id of
each goes on. Its signature holds ROWS * BANDS minima under
universal hash functions; documents that agree on all minima of a band share a bucket.

Candidates. Two documents of similarity 0.8 share no bucket with probability
``(1 - 0.8^ROWS)^BANDS``, 2e-6. A bucket never gives all its pairs. First every member is
paired with the bucket's smallest id, and components are formed from the links. In a bucket
that still holds several components, the members outside its largest one are queries, held
against all members in blocks of bounded size by their signatures alone; a pair that these
allow is taken in the first bucket that it shares. Pairs are verified on signatures and
confirmed on full sets (of 64-bit hashes, not of words). A signature is 8 bits of each minimum
(the bound lies four standard deviations below the threshold) and a parity bitmap of the set:
each bit in which two bitmaps differ stands for another shingle that only one set has, so too
many differing bits rule a link out with certainty.

Components come from alternating large-star and small-star.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import cut, ids_and_text, join_hot, stage, trimmed
from quillon.llm.components import connected_components
from quillon.llm.token_files import slices

ROWS, BANDS = 7, 56
BLOCK = 1024
THRESHOLD = 80  # per cent
MARGIN = 0.08  # of the signature estimate below the threshold: four standard deviations of 392 minima
BITMAP = 512  # bytes
#: Rows of a table of ids that may be broadcast (up to 24 bytes each); larger ones are shuffled.
BROADCAST_ROWS = 200_000
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_SETS = "doc_id long, n_shingles long, s1 long, s2 long, bands array<long>, sig binary, h long"


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def parity_bitmap(grams: np.ndarray) -> np.ndarray:
    """Bit i: whether the set has an odd number of hashes that end in i."""
    return np.packbits(np.bincount((grams & np.uint64(8 * BITMAP - 1)).astype(np.int64), minlength=8 * BITMAP) & 1)


def most_differing(x: np.ndarray, y: np.ndarray, threshold: int) -> np.ndarray:
    """The largest symmetric difference of sets of these sizes whose similarity reaches the threshold (per cent)."""
    return (x + y) * (100 - threshold) // (100 + threshold)


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of the texts, and where each text's words begin (one more entry than texts)."""
    words = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    offsets = words.offsets.to_numpy().astype(np.int64)
    coded = words.flatten().dictionary_encode()
    known = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, known), np.uint64, len(known))
    codes = coded.indices.to_numpy()
    if "" in known:  # from white space at an end
        keep = codes != known.index("")
        offsets = np.concatenate([[0], np.cumsum(keep)])[offsets - offsets[0]]
        codes = codes[keep]
    return hashes[codes], offsets - offsets[0]


def shingle_sets(texts: pa.Array, width: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    words, offsets = word_hashes(texts)
    seed = np.uint64(0x9E3779B97F4A7C15)
    grams = _mix(words + seed) if len(words) else words
    for k in range(1, width):
        grams = _mix(grams[: max(0, len(words) - k)] * seed + words[k:])
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        if b - a >= width:
            yield np.unique(grams[a : b - width + 1])
        elif b == a:
            yield np.zeros(0, np.uint64)
        else:
            whole = np.array([b - a], np.uint64)
            for w in words[a:b]:
                whole = _mix(whole * seed + w)
            yield whole


class Minima:
    """Signatures under ROWS * BANDS multiply-add hash functions modulo 2^32."""

    def __init__(self, seed: int = 7) -> None:
        rng = np.random.default_rng(seed)
        self.a = rng.integers(0, 1 << 31, ROWS * BANDS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
        self.b = rng.integers(0, 1 << 32, ROWS * BANDS, dtype=np.uint32)
        self.c = rng.integers(0, 1 << 63, ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def __call__(self, sets: list[np.ndarray]) -> np.ndarray:
        """One row of minima for each (non-empty) set."""
        flat = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32)
        starts = np.cumsum([0, *map(len, sets[:-1])])
        out, held = np.empty((len(self.a), len(sets)), np.uint32), np.empty_like(flat)
        for k in range(len(self.a)):
            np.multiply(flat, self.a[k], out=held)
            np.add(held, self.b[k], out=held)
            np.minimum.reduceat(held, starts, out=out[k])
        return out.T

    def bands(self, minima: np.ndarray) -> np.ndarray:
        """A 64-bit bucket key for each document and band."""
        parts = minima.reshape(len(minima), BANDS, ROWS).astype(np.uint64)
        return _mix((_mix(parts + self.c) * self.c).sum(axis=2, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64))


def signatures(texts: DataFrame, width: int) -> DataFrame:
    """doc_id, n_shingles, set hash, band keys, short signature and h of every row of (doc_id, text, h); bands are empty for empty sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashing = Minima()
        for batch in batches:
            for some in slices(batch, 1 << 20):
                sets = list(shingle_sets(some.column(1), width))
                sizes = np.array([len(s) for s in sets], np.int64)
                s1, s2 = (np.array([int(_mix(s ^ m).sum(dtype=np.uint64)) if len(s) else 0 for s in sets], np.uint64).view(np.int64) for m in (np.uint64(0), _M2))
                full = np.flatnonzero(sizes)
                bands, sig = np.zeros((len(sets), BANDS), np.int64), np.zeros((len(sets), ROWS * BANDS + BITMAP), np.uint8)
                at = 0
                while at < len(full):  # blocks that stay in the processor's cache
                    end = at + max(1, int(np.searchsorted(np.cumsum(sizes[full[at:]]), 60_000, "right")))
                    minima = hashing([sets[i] for i in full[at:end]])
                    bands[full[at:end]] = hashing.bands(minima).view(np.int64)
                    sig[full[at:end], : ROWS * BANDS] = minima.astype(np.uint8)
                    sig[full[at:end], ROWS * BANDS :] = [parity_bitmap(sets[i]) for i in full[at:end]]
                    at = end
                offsets = np.concatenate([[0], np.cumsum(np.where(sizes > 0, BANDS, 0))]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(bands[full].reshape(-1)))
                short = pa.array([x.tobytes() for x in sig], pa.binary())
                yield pa.record_batch([some.column(0), pa.array(sizes), pa.array(s1), pa.array(s2), lists, short, some.column(2)], names=["doc_id", "n_shingles", "s1", "s2", "bands", "sig", "h"])

    return texts.mapInArrow(trimmed(run), _SETS)


def _near(df: DataFrame) -> DataFrame:
    """Broadcast an id table if its checked size allows."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def similarity(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Estimates from short signatures (last axis), corrected for chance agreement of 8 bits."""
    return ((x == y).mean(axis=-1, dtype=np.float32) - 1 / 256) / (1 - 1 / 256)


def _bytes(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), -1)


def alike_signatures(pairs: DataFrame, signed: DataFrame, threshold: int) -> DataFrame:
    """The pairs (a, b) whose signatures agree enough."""
    least, cut_at = threshold / 100 - MARGIN, ROWS * BANDS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if len(b):
                x, y = _bytes(b.column(2)), _bytes(b.column(3))
                sizes = (b.column(c).to_numpy() for c in (4, 5))
                differing = np.bitwise_count(x[:, cut_at:] ^ y[:, cut_at:]).sum(axis=1, dtype=np.int64)
                fit = (similarity(x[:, :cut_at], y[:, :cut_at]) >= least) & (differing <= most_differing(*sizes, threshold))
                yield b.select(["a", "b"]).filter(pa.array(fit))

    one = lambda k: signed.select(F.col("doc_id").alias(k), F.col("sig").alias(f"sig_{k}"), F.col("n_shingles").alias(f"n_{k}"))
    joined = pairs.join(one("a"), "a").join(one("b"), "b")
    return joined.select("a", "b", "sig_a", "sig_b", "n_a", "n_b").mapInArrow(trimmed(run), "a long, b long")


def crossing_pairs(members: DataFrame, links: DataFrame, signed: DataFrame, threshold: int) -> DataFrame:
    """Likely pairs (a, b) within a bucket but across components."""
    least, cut_at = threshold / 100 - MARGIN, ROWS * BANDS
    reached = connected_components(links).withColumnRenamed("id", "doc_id")
    placed = members.join(reached, "doc_id", "left").select("key", "doc_id", F.coalesce("component", "doc_id").alias("component"))
    sizes = placed.groupBy("key", "component").agg(F.count(F.lit(1)).alias("k"))
    torn = sizes.groupBy("key").agg(F.count(F.lit(1)).alias("parts"), F.sum("k").alias("n"), F.max(F.struct("k", "component")).alias("top")).filter("parts > 1")
    blocks = F.ceil(F.col("n") / F.lit(float(BLOCK))).cast("int")
    rest = placed.join(torn.select("key", blocks.alias("blocks"), F.col("top.component").alias("major")), "key").join(signed.select("doc_id", "n_shingles", "sig", "bands"), "doc_id")
    targets = rest.select("key", F.pmod(F.xxhash64("doc_id"), "blocks").cast("int").alias("block"), F.lit(0).alias("query"), "doc_id", "component", "n_shingles", "sig", "bands")
    queries = rest.filter("component <> major").select("key", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(1).alias("query"), "doc_id", "component", "n_shingles", "sig", "bands")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {0: [], 1: []}
        out: list[tuple[int, int]] = []

        def compare(key: int) -> None:
            """Queries against the targets of the block; targets stay."""
            if held[0] and held[1]:
                (ti, tc, tn, ts, tb), (qi, qc, qn, qs, qb) = (tuple(zip(*held[k], strict=True)) for k in (0, 1))
                ti, tc, tn, tb, qc, qn, qb = (np.array(x, np.int64) for x in (ti, tc, tn, tb, qc, qn, qb))
                t, q = (np.frombuffer(b"".join(x), np.uint8).reshape(len(x), -1) for x in (ts, qs))
                for i in range(0, len(q), 16):
                    share = similarity(q[i : i + 16, None, :cut_at], t[None, :, :cut_at])
                    share[qc[i : i + 16, None] == tc[None]] = -1.0
                    sizes = qn[i : i + 16, None], tn[None]
                    share[100 * np.minimum(*sizes) < threshold * np.maximum(*sizes)] = -1.0
                    for row in range(len(share)):
                        fit = np.flatnonzero(share[row] >= least)
                        differing = np.bitwise_count(t[fit, cut_at:] ^ q[i + row, cut_at:]).sum(axis=1, dtype=np.int64)
                        fit = fit[differing <= most_differing(tn[fit], qn[i + row], threshold)]
                        if len(fit):  # a pair belongs to the first bucket that it shares
                            fit = fit[qb[i + row][(tb[fit] == qb[i + row]).argmax(axis=1)] == key]
                        mine = qi[i + row]
                        out.extend((min(mine, x), max(mine, x)) for x in ti[fit].tolist())
            held[1] = []

        group = None
        for b in batches:
            for key, block, query, *rest in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if (key, block) != group:
                    compare(group[0] if group else 0)
                    group, held[0] = (key, block), []
                held[query].append(rest)
                if len(held[1]) >= 512:
                    compare(key)
            if out:
                yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*set(out), strict=True)], names=["a", "b"])
                out.clear()
        if group:
            compare(group[0])
        if out:
            yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*set(out), strict=True)], names=["a", "b"])

    dealt = targets.union(queries).repartition("key", "block").sortWithinPartitions("key", "block", "query")
    return dealt.mapInArrow(trimmed(run), "a long, b long").distinct()


def full_sets(texts: DataFrame, ids: DataFrame, width: int) -> DataFrame:
    """vertex and the sorted distinct shingle hashes (binary, 64 bits each) of the rows in ids (r_id, r_h, vertex)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in slices(batch, 2 << 20):
                yield pa.record_batch([some.column(0), pa.array([s.tobytes() for s in shingle_sets(some.column(1), width)], pa.binary())], names=["vertex", "grams"])

    return texts.join(_near(ids), same_row(texts)).select("vertex", "text").mapInArrow(trimmed(run), "vertex long, grams binary")


def _repeated(signed: DataFrame) -> DataFrame:
    """(doc_id, h) of the rows with words that occur more than once."""
    return signed.filter("n_shingles > 0").groupBy("doc_id", "h").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("doc_id", "h")


def same_row(rows: DataFrame) -> Column:
    """Whether a row (doc_id, h) is the representative (r_id, r_h) of a vertex."""
    return rows["doc_id"].eqNullSafe(F.col("r_id")) & (rows["h"] == F.col("r_h"))


def confirm(pairs: DataFrame, texts: DataFrame, one: DataFrame, width: int, threshold: int) -> DataFrame:
    """The pairs (u, v) of vertices with 100 * intersection >= threshold * union on full sets."""
    ids = pairs.select(F.col("a").alias("vertex")).union(pairs.select("b")).distinct()
    wanted = cut(one.join(_near(cut(ids)), "vertex").select("r_id", "r_h", "vertex"))
    sets = stage(full_sets(texts, wanted, width).dropDuplicates(["vertex"]), "sets")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = (np.frombuffer(z.as_py(), np.uint64) for z in (x, y))
                shared = len(x) + len(y) - len(np.union1d(x, y)) if len(x) and len(y) else 0
                keep.append(shared > 0 and 100 * shared >= threshold * (len(x) + len(y) - shared))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_())).rename_columns(["u", "v"])

    joined = pairs.join(sets.select(F.col("vertex").alias("a"), F.col("grams").alias("grams_a")), "a").join(sets.select(F.col("vertex").alias("b"), F.col("grams").alias("grams_b")), "b")
    return joined.select("a", "b", "grams_a", "grams_b").mapInArrow(trimmed(run), "u long, v long").distinct()


def find_links(signed: DataFrame, placed: DataFrame, texts: DataFrame, width: int, threshold: int) -> DataFrame:
    """Links (u, v) between vertices that connect exactly those connected by similarity.

    Each set is represented by one of its rows, that of the smallest doc_id and text hash.
    """
    one = stage(placed.groupBy("vertex").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "h")).alias("m")).select("vertex", F.col("m.doc_id").alias("r_id"), F.col("m.h").alias("r_h")), "representatives")
    rows, once = signed.filter("n_shingles > 0"), _repeated(signed).isEmpty()

    def of_vertices(representatives: DataFrame, *columns: str) -> DataFrame:
        """These columns of the representatives' rows; doc_id is the vertex."""
        mine = rows.join(_near(representatives), same_row(rows)).select(F.col("vertex").alias("doc_id"), *columns)
        return mine if once else mine.dropDuplicates(["doc_id"])

    # all vertices move with their band keys only, the few that share a bucket with their signatures too
    buckets = stage(of_vertices(one, "bands"), "bands").select(F.explode("bands").alias("key"), "doc_id")
    sizes = buckets.groupBy("key").agg(F.min("doc_id").alias("leader"), F.max("doc_id").alias("last"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    sizes = stage(sizes, "buckets")
    members = stage(buckets.join(sizes.filter("n > 2").select("key", "leader"), "key"), "members")
    led = sizes.filter("n = 2").select(F.col("leader").alias("a"), F.col("last").alias("b")).union(members.select(F.col("leader").alias("a"), F.col("doc_id").alias("b")))
    active = cut(led.select("a").union(led.select("b")).distinct().withColumnRenamed("a", "vertex"))
    signed = stage(of_vertices(one.join(_near(active), "vertex", "left_semi"), "n_shingles", "sig", "bands"), "vertices")
    likely = cut(alike_signatures(led.filter("a < b").distinct(), signed, threshold).distinct())
    links = cut(confirm(likely, texts, one, width, threshold))
    pairs = cut(crossing_pairs(members, links, signed, threshold).join(likely, ["a", "b"], "left_anti"))
    return links.union(confirm(pairs, texts, one, width, threshold))


def _sets_of(texts: DataFrame, width: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Signed rows; their vertices (doc_id, h, vertex); and the vertices' sets, each with its smallest doc_id.

    A vertex is a distinct set, numbered by its smallest doc_id; where several sets share that
    (rows of one id with different texts) or have none, by a hash of the set.
    """
    signed = stage(signatures(texts, width), "signatures")
    known = signed.filter("n_shingles > 0").select("doc_id", "h", "s1", "s2", "n_shingles")
    # written first: a join of two plain exchanges is one whose hot keys adaptive execution can split
    groups = stage(known.groupBy("s1", "s2", "n_shingles").agg(F.min("doc_id").alias("first")), "groups")
    shared = groups.groupBy("first").agg(F.count(F.lit(1)).alias("sets")).filter("sets > 1 OR first IS NULL").select(F.col("first").alias("several"))
    marked = groups.join(_near(cut(shared.withColumn("odd", F.lit(True)))), F.col("first").eqNullSafe(F.col("several")), "left")
    vertex = F.when(F.col("odd"), F.xxhash64("s1", "s2", "n_shingles")).otherwise(F.col("first"))
    sets = stage(marked.select("s1", "s2", "n_shingles", "first", vertex.alias("vertex")), "sets-numbered")
    placed = stage(known.join(sets, ["s1", "s2", "n_shingles"]).select("doc_id", "h", "vertex"), "placed")
    return signed, placed, sets


def near_duplicates(docs: DataFrame, width: int = 5, threshold: int = THRESHOLD) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable) and kept, one row per input row.

    Null and empty texts have no set and are linked with nothing; a text of fewer than
    ``width`` words is one shingle; very long texts are hashed whole. Rows of one doc_id are one
    vertex, linked wherever any of their texts is. Rows without doc_id have a null component
    and are kept. Extra columns are ignored; an empty table gives an empty result.
    """
    texts = ids_and_text(docs).withColumn("h", F.xxhash64("text"))
    signed, placed, sets = _sets_of(texts.filter("doc_id IS NOT NULL"), width)
    several = placed.groupBy("doc_id").agg(F.min("vertex").alias("lo"), F.max("vertex").alias("hi")).filter("lo < hi")
    same_id = placed.join(several, "doc_id").select(F.col("lo").alias("u"), F.col("vertex").alias("v"))
    links = find_links(signed, placed, texts, width, threshold)
    reached = stage(connected_components(links.union(same_id)), "components")
    # copies stay out of the graph: they take the component of their set
    ids = sets.join(reached, F.col("vertex") == F.col("id"), "left").select("vertex", "first", F.coalesce("component", "vertex").alias("root"))
    ids = stage(ids, "roots")
    least = ids.groupBy("root").agg(F.min("first").alias("component"), F.count(F.lit(1)).alias("n"))
    by_set = stage(join_hot(ids, least, ["root"], ids.count()).select(F.col("vertex").alias("v"), "component"), "by-set")
    by_doc = placed.join(by_set, F.col("vertex") == F.col("v")).groupBy(F.col("doc_id").alias("id")).agg(F.min("component").alias("component"))
    joined = signed.select("doc_id", "n_shingles").join(by_doc, F.col("doc_id") == F.col("id"), "left")
    component = F.coalesce("component", "doc_id")
    found = joined.select("doc_id", "n_shingles", component.alias("component_id"), (F.col("doc_id") == component).alias("kept"))
    nameless = signatures(texts.filter("doc_id IS NULL"), width).select("doc_id", "n_shingles", F.lit(None).cast("long").alias("component_id"), F.lit(True).alias("kept"))
    return found.union(nameless)


def drop_near_duplicates(docs: DataFrame, width: int = 5, threshold: int = THRESHOLD) -> DataFrame:
    """One row of each group of near-duplicate texts, all columns as they were.

    Groups are made of texts, not of ids: rows of one doc_id with different texts are judged
    apart, and rows without doc_id take part like others. The row of the smallest doc_id stays
    (null comes last), of equal ones the smallest text; rows with empty texts all stay.
    """
    text = F.coalesce(docs["text"].cast("string"), F.lit(""))
    texts = ids_and_text(docs).withColumn("h", F.xxhash64("text"))
    signed, placed, sets = _sets_of(texts, width)
    reached = stage(connected_components(find_links(signed, placed, texts, width, threshold)), "components")
    rooted = stage(sets.select("vertex").join(reached, F.col("vertex") == F.col("id"), "left").select(F.col("vertex").alias("v"), F.coalesce("component", "vertex").alias("root")), "rooted")
    rows = stage(placed.distinct().join(rooted, F.col("vertex") == F.col("v")).select("doc_id", "h", "root"), "rooted-rows")
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "h")
    best = rows.groupBy("root").agg(F.min(order).alias("m")).select("root", F.col("m.doc_id").alias("__id"), F.col("m.h").alias("__h"))
    kept = stage(best.select("__id", "__h"), "kept")
    gone = cut(rows.join(kept, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("h") == F.col("__h")), "left_anti").select(F.col("doc_id").alias("__id"), F.col("h").alias("__h")))
    identity = lambda side: docs["doc_id"].cast("long").eqNullSafe(side["__id"]) & (F.xxhash64(text) == side["__h"])
    side = _near(gone)
    left = docs.join(side, identity(side), "left_anti")
    again = cut(_repeated(signed).select(F.col("doc_id").alias("__id"), F.col("h").alias("__h")))
    if again.isEmpty():
        return left
    side = _near(again)
    single = left.join(side, identity(side), "left_anti")
    repeated = left.join(side, identity(side), "left_semi")
    columns = F.struct(*[repeated[c].alias(c) for c in docs.columns])
    # the least row of each, combined before the shuffle, so that many repeats cost no more than one
    one = repeated.groupBy(repeated["doc_id"].alias("__id"), F.xxhash64(repeated["text"]).alias("__h")).agg(F.min_by(columns, F.to_json(columns)).alias("__row"))
    return single.unionByName(one.select(*[F.col("__row")[c].alias(c) for c in docs.columns]))
