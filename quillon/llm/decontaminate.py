"""Benchmark decontamination by size-partitioned MinHash containment search.

Items are short and documents long, so the search runs from the item's side. Items are
partitioned by size: partition p holds those of 2^p to 2^(p+1) - 1 distinct shingles. The
signature of an item is its bottom-k sketch, the ``k_p`` smallest shingle hashes, where k_p
belongs to the partition: as many as its largest item may lack at containment t, and
``EXTRA`` more. The signature of a document are its shingle hashes up to the largest minimum
of any item, so one pass over a text serves all partitions. A document that contains a share t
of an item's shingles lacks at most ``floor((1 - t) n)`` of them, hence holds at least
``h_p = min(k_p, 2^p) - floor((1 - t) (2^(p+1) - 1))`` of its minima (1 at least): this is the
containment threshold of the partition, and it loses nothing. Candidates are then verified by
exact containment of the full sets of shingles, compared as words. All steps are DataFrame
expressions.

Words are maximal runs of letters and digits of the lower-cased text. An item of fewer words
than a shingle has is matched as one shingle of its own length. Whether a text is contaminated
depends on the text alone, so rows are told apart by the SHA-256 of their text, never by id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import cut, let

WIDTH = 5
THRESHOLD = 0.8
#: Minima of a signature beyond those that an item may lack.
EXTRA = 4
#: Rows of an index or candidate table that may be broadcast (at most about 90 bytes each); larger tables are shuffled.
BROADCAST_ROWS = 200_000


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def text_key(text: Column) -> Column:
    """What rows of one text share; null counts as empty."""
    return F.sha2(F.coalesce(text.cast("string"), F.lit("")), 256)


def hashed_shingles(hashes: Column, width: int | Column) -> Column:
    """64-bit hashes of the word n-grams, from the words' hashes; empty if there are fewer words."""
    if isinstance(width, int):
        gram = lambda i: F.xxhash64(*[F.get(hashes, i + k) for k in range(width)])
    else:
        gram = lambda i: F.xxhash64(*[F.when(F.lit(k) < width, F.get(hashes, i + k)) for k in range(WIDTH)])
    n = F.lit(width) if isinstance(width, int) else width
    return F.when(F.size(hashes) < n, F.array().cast("array<long>")).otherwise(F.transform(F.sequence(F.lit(0), F.size(hashes) - n), gram))


def word_shingles(text: Column, width: int) -> Column:
    """The distinct word n-grams of a text, as words joined by blanks."""
    gram = lambda w: lambda i: F.concat_ws(" ", F.slice(w, i + 1, F.lit(width)))
    none = F.array().cast("array<string>")
    return let(words(text), lambda w: F.when(F.size(w) < width, none).otherwise(F.array_distinct(F.transform(F.sequence(F.lit(0), F.size(w) - width), gram(w)))))


def may_lack(n: Column, threshold: float) -> Column:
    return F.floor(F.lit(1.0 - threshold) * n + F.lit(1e-9)).cast("int")


def index_items(items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """item_id, width, grams (all shingles as words), n (their number), part (size partition), minima (signature) and needed (the partition's threshold).

    Items without words (null, empty) have no shingles and are left out: nothing contains them.
    Repeated item ids stay separate rows; they report separately and are made distinct at the end.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    sized = items.select(F.col("item_id").cast("long").alias("item_id"), text.alias("text")).withColumn("width", F.least(F.lit(WIDTH), F.size(words(F.col("text"))))).filter("width > 0")
    grams = F.coalesce(*[F.when(F.col("width") == w, word_shingles(F.col("text"), w)) for w in range(1, WIDTH + 1)])
    hashes = let(F.transform(words(F.col("text")), lambda w: F.xxhash64(w)), lambda h: F.array_distinct(hashed_shingles(h, F.col("width"))))
    counted = sized.select("item_id", "width", grams.alias("grams"), hashes.alias("hashes")).withColumn("n", F.size("grams")).withColumn("part", F.length(F.bin("n")) - 1)
    least = F.pow(F.lit(2.0), F.col("part"))
    lacking = may_lack(2 * least - 1, threshold)
    k = lacking + F.lit(EXTRA)
    needed = F.greatest(F.lit(1), F.least(k, least.cast("int")) - lacking)
    return counted.select("item_id", "width", "grams", "n", "part", F.slice(F.sort_array("hashes"), F.lit(1), k).alias("minima"), needed.alias("needed"))


def document_signature(text: Column, bounds: dict[int, int]) -> Column:
    """Distinct shingle hashes of the widths in ``bounds`` up to the bound of each width."""
    below = lambda top: lambda g: g <= F.lit(top)
    return let(F.transform(words(text), lambda w: F.xxhash64(w)), lambda h: F.array_distinct(F.concat(*[F.filter(hashed_shingles(h, w), below(top)) for w, top in sorted(bounds.items())])))


def find_candidates(texts: DataFrame, index: DataFrame) -> DataFrame:
    """(key, item_id) of the texts (key, text) that hold as many minima of an item as its partition demands."""
    # at most WIDTH rows
    bounds = {r["width"]: r["top"] for r in index.groupBy("width").agg(F.max(F.element_at("minima", -1)).alias("top")).collect()}
    if not bounds:
        return texts.select("key", F.lit(0).cast("long").alias("item_id")).limit(0)
    minima = index.select("item_id", "needed", F.explode("minima").alias("gram")).distinct()
    side = F.broadcast(minima) if minima.count() <= BROADCAST_ROWS else minima
    probes = texts.select("key", F.explode(document_signature(F.col("text"), bounds)).alias("gram"))
    hits = probes.join(side, "gram").groupBy("key", "item_id", "needed").agg(F.count_distinct("gram").alias("hits"))
    return hits.filter("hits >= needed").select("key", "item_id").distinct()


def verified_pairs(docs: DataFrame, items: DataFrame, threshold: float) -> DataFrame:
    """doc_id, key, item_id, n and n_shared of all rows whose text contains an item."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).withColumn("key", text_key(F.col("text")))
    index = cut(index_items(items, threshold))
    candidates = cut(find_candidates(texts, index))
    grouped = candidates.groupBy("key").agg(F.collect_list("item_id").alias("items"))  # at most the items that share shingles with one text
    near = F.broadcast(grouped) if candidates.count() <= BROADCAST_ROWS else grouped
    named = index.select(F.col("item_id").alias("i"), "width", "grams", "n")
    side = F.broadcast(named) if index.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] <= BROADCAST_ROWS else named
    pairs = texts.join(near, "key").select("doc_id", "key", "text", F.explode("items").alias("item_id")).join(side, F.col("item_id").eqNullSafe(F.col("i")))
    grams = F.coalesce(*[F.when(F.col("width") == w, word_shingles(F.col("text"), w)) for w in range(1, WIDTH + 1)])
    shared = pairs.select("doc_id", "key", "item_id", "n", F.size(F.array_intersect("grams", grams)).alias("n_shared"))
    return shared.filter(F.col("n_shared") >= F.lit(threshold) * F.col("n") - F.lit(1e-9))


def find_contaminated(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Pairs with containment >= threshold: doc_id, item_id, n_item_shingles, n_shared, containment.

    Null and empty documents contain nothing; repeated rows of one doc_id are judged each by
    its own text and reported once, with the largest n_shared; null doc_ids are reported as
    null. Extra columns of either table are ignored; an empty table gives no pairs.
    """
    kept = verified_pairs(docs, items, threshold)
    each = kept.groupBy("doc_id", "item_id", F.col("n").cast("long").alias("n_item_shingles")).agg(F.max("n_shared").cast("long").alias("n_shared"))
    return each.withColumn("containment", F.col("n_shared") / F.col("n_item_shingles"))


def decontaminate(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows whose text contains no item, all columns as they were; every row is judged by its own text, whatever its id."""
    bad = cut(verified_pairs(docs, items, threshold).select(F.col("key").alias("__bad")).distinct())
    side = F.broadcast(bad) if bad.count() <= BROADCAST_ROWS else bad
    return docs.join(side, text_key(docs["text"]) == side["__bad"], "left_anti")
