"""Removal of repeated byte strings by hash-compared suffix sorting.

Every byte covered by a string of ``LENGTH`` bytes that also starts anywhere else, in the
same text or another, is removed. Strings never cross texts and are judged on the input.

0. Texts. Each distinct text is worked on once; where it has several rows all of its bytes are
   repeated. Texts shorter than LENGTH stay whole. Texts travel compressed.
1. Anchors. A window of LENGTH bytes is assigned to the anchor with the smallest hash among
   the K-byte strings in it (the leftmost of equals). The choice depends on the window's
   bytes alone, so equal windows have equal anchors at equal places, and consecutive windows
   share an anchor: about 1.3 % of all positions stand for all windows. A run of windows with
   one anchor is a *context*; it travels as its digest and a place, not as bytes.
2. Contexts. Anchors that occur once are unique. Where all contexts of an anchor are equal,
   all of their windows are repeated; likewise a context that occurs twice or more. Texts and
   contexts count as equal if their 128-bit BLAKE2b digests are (no byte check: no two byte
   strings with one digest are known).
3. Suffix sort. Only distinct contexts of one anchor remain. Their suffixes from the anchor
   are sorted by a mergesort whose comparisons find common extensions by binary search over
   prefix polynomial hashes, and so are their reversed prefixes; every common extension of
   neighbours that is used is checked byte by byte, and an anchor where the check fails is
   sorted by its bytes instead. At offset o, windows are equal where suffixes agree on
   LENGTH - o bytes and prefixes on o: runs in the two sorted orders.
4. Large groups. A group of more than ``SORTED`` contexts is split before it is sorted: its
   range of offsets is halved, every context is cut to the bytes of its windows in each half, and
   within a half contexts are grouped by the digest of the bytes that all windows of that half
   have in common, so equal windows stay together. Cut contexts of one digest are repeated as a
   whole and only one of them goes on. This repeats, in distributed rounds, until a group fits;
   at a single offset it is one context. No task ever gathers more than ``SORTED`` contexts of a
   group, and what grows in a round are only contexts that still differ.
5. Removal. Ranges are joined to the distinct texts by digest, so rows need no ids.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import ids_and_text, join_hot, stage, trimmed

LENGTH = 200
K = 48
WIDTH = LENGTH - K + 1  # anchors a window chooses from
SORTED = 2_000
CHUNK = 2 << 20  # bytes worked on at once
_BASE = 0x9E3779B97F4A7C15 | 1
_PLACE = np.uint64(0xFFFFFF)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class PrefixHashes:
    """Polynomial hashes modulo 2^64 of all substrings of a byte array, by prefix sums."""

    def __init__(self) -> None:
        self.table = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))
        self.up, self.down = np.ones(1, np.uint64), np.ones(1, np.uint64)

    def powers(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            n = max(n, 1 << 16)
            with np.errstate(over="ignore"):
                for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
                    steps = np.full(n, base, np.uint64)
                    steps[0] = 1
                    setattr(self, name, np.multiply.accumulate(steps))
        return self.up, self.down

    def prefix(self, data: np.ndarray) -> np.ndarray:
        """One entry more than bytes."""
        out = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.table[data] * self.powers(len(data) + 1)[0][: len(data)], out=out[1:])
        return out

    def of(self, prefix: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Hashes of the substrings of these sizes at these places."""
        return (prefix[start + size] - prefix[start]) * self.down[start]


def sliding_minimum(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of ``width`` entries."""
    n = len(x) - width + 1
    padded = np.full(-(-len(x) // width) * width, np.iinfo(x.dtype).max, x.dtype)
    padded[: len(x)] = x
    rows = padded.reshape(-1, width)
    left = np.minimum.accumulate(rows, axis=1).reshape(-1)
    right = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(right[:n], left[width - 1 : width - 1 + n])


def find_anchors(hashes: PrefixHashes, data: bytes, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """Contexts of the pieces [start, end) of data: piece, first window, last window, anchor, anchor hash, context digest (two columns)."""
    raw = np.frombuffer(data, np.uint8)
    none = np.zeros(0, np.int64)
    if len(raw) < LENGTH:
        return none, none, none, none, none, none.reshape(0, 2)
    prefix = hashes.prefix(raw)
    grams = mix((prefix[K:] - prefix[:-K]) * hashes.down[: len(raw) - K + 1])
    chosen = sliding_minimum((grams & ~_PLACE) | np.arange(len(grams), dtype=np.uint64), WIDTH) & _PLACE
    long = ends - starts >= LENGTH
    edge = np.zeros(len(chosen) + 1, np.int8)
    edge[starts[long]] += 1
    edge[ends[long] - LENGTH + 1] -= 1  # pieces follow each other, so no entry gets two of a kind
    windows = np.flatnonzero(np.cumsum(edge[:-1], dtype=np.int8))
    if not len(windows):
        return none, none, none, none, none, none.reshape(0, 2)
    anchors = chosen[windows].astype(np.int64)
    new = np.flatnonzero((np.diff(anchors) != 0) | (np.diff(windows) != 1)) + 1
    first, last = windows[np.concatenate([[0], new])], windows[np.concatenate([new - 1, [len(windows) - 1]])]
    anchor = anchors[np.concatenate([[0], new])]
    view = memoryview(data)
    digests = b"".join([blake2b(view[a : b + LENGTH], digest_size=16).digest() for a, b in zip(first.tolist(), last.tolist(), strict=True)])
    context = np.frombuffer(digests, np.int64).reshape(-1, 2)
    return np.searchsorted(starts, first, "right") - 1, first, last, anchor, grams[anchor].view(np.int64), context


def pieces(texts: list[bytes], size: int) -> Iterator[list[tuple[int, int, bytes]]]:
    """(text, offset, bytes) in lists of about ``size`` bytes; longer texts in overlapping pieces that share no window."""
    held, total = [], 0
    for i, t in enumerate(texts):
        for at in range(0, max(1, len(t) - LENGTH + 1), size):
            piece = t[at : at + size + LENGTH - 1]
            if len(piece) < LENGTH:
                continue
            held.append((i, at, piece))
            total += len(piece)
            if total >= size:
                yield held
                held, total = [], 0
    if held:
        yield held


def digest(t: bytes) -> tuple[int, int]:
    return struct.unpack("<qq", blake2b(t, digest_size=16).digest())


def batch_of(schema: str, columns: list) -> pa.RecordBatch:
    types = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}
    fields = [x.split() for x in schema.split(", ")]
    return pa.record_batch([pa.array(c, types[t]) for c, (_, t) in zip(columns, fields, strict=True)], names=[n for n, _ in fields])


_ROWS = "doc_id long, t1 long, t2 long, n_bytes long, sha string, packed binary"


def compressed(docs: DataFrame) -> DataFrame:
    """doc_id, text digest, n_bytes and the compressed bytes of every text; of short texts, which stay whole, the SHA-256 and the bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            data = [(x.as_py() or "").encode() for x in batch.column(1)]
            short = [len(t) < LENGTH for t in data]
            keys = list(zip(*map(digest, data), strict=True)) or [(), ()]
            sha = [hashlib.sha256(t).hexdigest() if s else None for t, s in zip(data, short, strict=True)]
            yield batch_of(_ROWS, [batch.column(0).to_pylist(), *keys, list(map(len, data)), sha, [t if s else pack(t) for t, s in zip(data, short, strict=True)]])

    return docs.mapInArrow(trimmed(run), _ROWS)


_CONTEXTS = "t1 long, t2 long, k long, place long, anchor long, c1 long, c2 long"


def contexts(unique: DataFrame) -> DataFrame:
    """One row per context of distinct texts (t1, t2, k, packed): place (first window, extent and anchor offset packed), anchor and context digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, unpack = PrefixHashes(), zstandard.ZstdDecompressor().decompress
        for batch in batches:
            keys = np.array([c.to_pylist() for c in batch.columns[:3]], np.int64)
            data = [unpack(x.as_py()) for x in batch.column(3)]
            for group in pieces(data, CHUNK):
                sizes = np.array([len(p) for *_, p in group])
                ends = np.cumsum(sizes)
                piece, first, last, anchor, gram, context = find_anchors(hashes, b"".join(p for *_, p in group), ends - sizes, ends)
                t1, t2, k = (column[[i for i, *_ in group]][piece] for column in keys)
                offset = np.array([at for _, at, _ in group], np.int64) - (ends - sizes)
                place = ((first + offset[piece]) << 16) | ((last - first) << 8) | (anchor - first)
                yield pa.record_batch([pa.array(x) for x in (t1, t2, k, place, gram, context[:, 0], context[:, 1])], names=[x.split()[0] for x in _CONTEXTS.split(", ")])

    return unique.select("t1", "t2", "k", "packed").mapInArrow(trimmed(run), _CONTEXTS)


class SuffixOrder:
    """Sorted order of the suffixes (or, backwards, prefixes) at given places of a byte array, within groups."""

    def __init__(self, hashes: PrefixHashes, raw: np.ndarray, prefix: np.ndarray, place: np.ndarray, room: np.ndarray, group: np.ndarray, back: bool) -> None:
        self.hashes, self.raw, self.prefix, self.place, self.room, self.group, self.back = hashes, raw, prefix, place, room, group, back
        self.order = self._sort()
        a, b = self.order[:-1], self.order[1:]
        same = self.group[a] == self.group[b]
        self.common = np.full(len(self.order), -1, np.int64)  # with the one before; -1: another group
        self.common[1:][same] = self.extension(a[same], b[same])
        wrong = self._unverified()
        for g in np.unique(self.group[self.order[wrong]]):
            self._sort_bytes(g)

    def _at(self, i: np.ndarray, size: np.ndarray) -> np.ndarray:
        start = self.place[i] - size if self.back else self.place[i]
        return self.hashes.of(self.prefix, start, size)

    def extension(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the common extension of pairs, by binary search over hashes."""
        low, high = np.zeros(len(a), np.int64), np.minimum(self.room[a], self.room[b])
        while (low < high).any():
            middle = (low + high + 1) // 2
            equal = self._at(a, middle) == self._at(b, middle)
            low, high = np.where(equal, middle, low), np.where(equal, high, middle - 1)
        return low

    def _byte(self, i: np.ndarray, n: np.ndarray) -> np.ndarray:
        """The byte after n common ones; -1 at the end."""
        inside = n < self.room[i]
        spot = np.where(inside, self.place[i] - 1 - n if self.back else self.place[i] + n, 0)
        return np.where(inside, self.raw[spot].astype(np.int64), -1)

    def less(self, a: np.ndarray, b: np.ndarray, or_equal: np.ndarray) -> np.ndarray:
        n = self.extension(a, b)
        x, y = self._byte(a, n), self._byte(b, n)
        return (x < y) | ((x == y) & or_equal)

    def _sort(self) -> np.ndarray:
        """Bottom-up mergesort of all groups at once: an element moves by its rank in the block beside its own."""
        n = len(self.group)
        order = np.argsort(self.group, kind="stable")
        starts = np.flatnonzero(np.concatenate([[True], np.diff(self.group[order]) != 0]))
        sizes = np.diff(np.concatenate([starts, [n]]))
        start, size = np.repeat(starts, sizes), np.repeat(sizes, sizes)
        rel = np.arange(n) - start
        width = 1
        while (active := np.flatnonzero(size > width)).size:
            block = rel[active] // width
            odd = block % 2 == 1
            own = block * width
            other = np.where(odd, own - width, own + width)
            size_of_other = np.clip(size[active] - other, 0, width)
            low, high = np.zeros(len(active), np.int64), size_of_other
            mine = order[active]
            base = start[active] + other
            while (open_ := np.flatnonzero(low < high)).size:
                middle = (low[open_] + high[open_]) // 2
                theirs = order[base[open_] + middle]
                before = self.less(theirs, mine[open_], odd[open_])  # equal ones: the left block's first
                low[open_] = np.where(before, middle + 1, low[open_])
                high[open_] = np.where(before, high[open_], middle)
            target = start[active] + np.minimum(own, other) + (rel[active] - own) + low
            order[target] = mine
            width *= 2
        return order

    def _rows(self, i: np.ndarray, most: int) -> np.ndarray:
        steps = np.arange(most)
        spots = self.place[i][:, None] + (-1 - steps if self.back else steps)
        return self.raw[np.clip(spots, 0, len(self.raw) - 1)]

    def _unverified(self) -> np.ndarray:
        """Places in the order whose common bytes, or whose order after them, the bytes do not bear out."""
        at = np.flatnonzero(self.common >= 0)
        bad = []
        for i in range(0, len(at), 20_000):
            k = at[i : i + 20_000]
            a, b, n = self.order[k - 1], self.order[k], self.common[k]
            most = int(n.max(initial=0))
            differ = (self._rows(a, most) != self._rows(b, most)) & (np.arange(most) < n[:, None])
            x, y = self._byte(a, n), self._byte(b, n)
            bad.append(k[differ.any(axis=1) | (x > y) | ((x == y) & (x >= 0))])
        return np.concatenate(bad) if bad else np.zeros(0, np.int64)

    def _sort_bytes(self, g: int) -> None:
        spots = np.flatnonzero(self.group[self.order] == g)
        data = self.raw.tobytes()

        def own(i: int) -> bytes:
            p, r = int(self.place[i]), int(self.room[i])
            return data[p - r : p][::-1] if self.back else data[p : p + r]

        ranked = sorted(self.order[spots].tolist(), key=own)
        self.order[spots] = ranked
        for k, (a, b) in zip(spots[1:].tolist(), zip(ranked[:-1], ranked[1:], strict=True), strict=True):
            x, y = own(a), own(b)
            self.common[k] = next((j for j in range(min(len(x), len(y))) if x[j] != y[j]), min(len(x), len(y)))

    def classes(self, size: int) -> np.ndarray:
        """For each element a number that it shares with those of its group that agree on ``size`` bytes."""
        out = np.empty(len(self.order), np.int64)
        out[self.order] = np.cumsum(self.common < size)
        return out


def repeated_windows(hashes: PrefixHashes, data: list[bytes], anchor: np.ndarray, group: np.ndarray) -> list[list[tuple[int, int]]]:
    """For distinct contexts (their bytes, anchor offsets and groups): the ranges of their bytes covered by shared windows."""
    sizes = np.array([len(x) for x in data], np.int64)
    begins = np.cumsum(sizes) - sizes
    raw = np.frombuffer(b"".join(data), np.uint8)
    prefix = hashes.prefix(raw)
    place = begins + anchor
    right = SuffixOrder(hashes, raw, prefix, place, sizes - anchor, group, False)
    left = SuffixOrder(hashes, raw, prefix, place, anchor, group, True)
    least = anchor - (sizes - LENGTH)  # offsets of a context: from its last window's to its first's
    shared = np.zeros((len(data), WIDTH + 1), bool)
    for o in range(WIDTH):
        able = np.flatnonzero((least <= o) & (o <= anchor))
        if len(able) < 2:
            continue
        key = right.classes(LENGTH - o)[able] * len(data) + left.classes(o)[able]
        order = np.argsort(key, kind="stable")
        ranked = key[order]
        equal = ranked[1:] == ranked[:-1]
        twice = np.concatenate([equal, [False]]) | np.concatenate([[False], equal])
        shared[able[order[twice]], o] = True
    out: list[list[tuple[int, int]]] = [[] for _ in data]
    steps = np.diff(np.pad(shared, ((0, 0), (1, 0))).astype(np.int8), axis=1)
    for (i, o), (_, e) in zip(np.argwhere(steps == 1).tolist(), np.argwhere(steps == -1).tolist(), strict=True):
        out[i].append((int(anchor[i]) - (e - 1), int(anchor[i]) - o + LENGTH))
    return out


_FETCHED = "g1 long, g2 long, lo int, hi int, n long, t1 long, t2 long, first long, anchor int, bytes binary"


def _fetch(joined: DataFrame) -> DataFrame:
    """The bytes of the wanted contexts of each text (columns t1, t2, packed, wanted), grouped by anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            rows, total = [], 0
            for t1, t2, packed, wanted in zip(*batch.columns, strict=True):
                text = unpack(packed.as_py())
                for w in wanted.as_py():
                    first, extent, offset = w["place"] >> 16, w["place"] >> 8 & 255, w["place"] & 255
                    rows.append((w["anchor"], 0, 0, WIDTH - 1, w["n"], t1.as_py(), t2.as_py(), first, offset, text[first : first + extent + LENGTH]))
                    total += extent + LENGTH
                    if total > 8 << 20:
                        yield batch_of(_FETCHED, list(zip(*rows, strict=True)))
                        rows, total = [], 0
            if rows:
                yield batch_of(_FETCHED, list(zip(*rows, strict=True)))

    return joined.select("t1", "t2", "packed", "wanted").mapInArrow(trimmed(run), _FETCHED)


_RANGES = "t1 long, t2 long, first long, last long"
_GROUP = ["g1", "g2", "lo", "hi"]


def _sort_groups(fetched: DataFrame) -> DataFrame:
    """Ranges of contexts that occur once, by suffix sort within each group (at most SORTED contexts each)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, held = PrefixHashes(), []

        def solve() -> pa.RecordBatch:
            numbers: dict[tuple, int] = {}
            group, anchor = np.array([(numbers.setdefault(r[:4], len(numbers)), r[8]) for r in held], np.int64).T
            found = repeated_windows(hashes, [r[9] for r in held], anchor, group)
            rows = [(r[5], r[6], r[7] + a, r[7] + b) for r, ranges in zip(held, found, strict=True) if r[4] == 1 for a, b in ranges]
            return batch_of(_RANGES, list(zip(*rows, strict=True)) or [()] * 4)

        for batch in batches:
            for r in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if len(held) >= 10_000 and r[:4] != held[-1][:4]:
                    yield solve()
                    held = []
                held.append(r)
        if held:
            yield solve()

    return fetched.repartition(*_GROUP).sortWithinPartitions(*_GROUP).mapInArrow(trimmed(run), _RANGES)


_HALVED = f"{_FETCHED}, d1 long, d2 long"


def _halve(large: DataFrame) -> DataFrame:
    """Every context of large groups, cut to its windows in either half of the group's offsets, with the digest of what is left."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for g1, g2, lo, hi, n, t1, t2, first, anchor, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                middle, least = (lo + hi) // 2, anchor - (len(data) - LENGTH)
                for a, b in ((lo, middle), (middle + 1, hi)):
                    x, y = max(least, a), min(anchor, b)
                    if x <= y:
                        group = digest(struct.pack("<qq", g1, g2) + data[anchor - a : anchor + LENGTH - b])
                        own = data[anchor - y : anchor - x + LENGTH]
                        rows.append((*group, a, b, n, t1, t2, first + anchor - y, y, own, *digest(own)))
            yield batch_of(_HALVED, list(zip(*rows, strict=True)) or [()] * 12)

    return large.mapInArrow(trimmed(run), _HALVED)


def _solve_groups(fetched: DataFrame) -> list[DataFrame]:
    """Frames of ranges: groups that fit are sorted; larger ones are halved in rounds (at most log2 WIDTH of them)."""
    found = []
    while True:
        sizes = stage(fetched.groupBy(*_GROUP).agg(F.count(F.lit(1)).alias("n_contexts")).filter("n_contexts > 1").withColumn("n", F.col("n_contexts")), "group-sizes")
        largest, total = sizes.agg(F.max("n_contexts"), F.sum("n_contexts")).first()
        if largest is None:
            return found
        if largest <= SORTED:
            found.append(_sort_groups(fetched.join(sizes.select(*_GROUP), _GROUP).select(*fetched.columns)))
            return found
        sized = stage(join_hot(fetched, sizes, _GROUP, total), "sized")
        found.append(_sort_groups(sized.filter(F.col("n_contexts") <= SORTED).select(*fetched.columns)))
        halved = stage(_halve(sized.filter(F.col("n_contexts") > SORTED).select(*fetched.columns)), "halved")
        keys = [*_GROUP, "d1", "d2"]
        cuts = halved.groupBy(*keys).agg(F.count(F.lit(1)).alias("k"), F.min("n").alias("least"), F.min(F.struct("t1", "t2", "first")).alias("one"), F.min("anchor").alias("anchor"), F.first("bytes").alias("bytes"))
        cuts = stage(cuts.select(*_GROUP, F.when(F.col("k") > 1, F.lit(2).cast("long")).otherwise(F.col("least")).alias("n"), "one.*", "anchor", "bytes", "d1", "d2", "k"), "cuts")
        again = join_hot(halved.filter("n = 1").select(*keys, "t1", "t2", "first", F.length("bytes").alias("size")), cuts.filter("k > 1").select(*keys, F.col("k").alias("n"), F.lit(True).alias("again")), keys, total)
        found.append(again.select("t1", "t2", "first", (F.col("first") + F.col("size")).alias("last")))
        fetched = cuts.select(*fetched.columns)


def repeated_ranges(unique: DataFrame) -> DataFrame:
    """t1, t2, first, last: byte ranges (which may overlap) that cover exactly the bytes to remove of the texts (t1, t2, k, packed) with k = 1."""
    found = contexts(unique)
    pair = F.struct("c1", "c2")
    often = found.groupBy("anchor").agg(F.sum("k").alias("times"), F.count(F.lit(1)).alias("n"), F.min(pair).alias("low"), F.max(pair).alias("high")).filter("times > 1")
    # written first: a join of two plain exchanges is one whose hot keys adaptive execution can split
    often = stage(often.select("anchor", "n", (F.col("low") < F.col("high")).alias("mixed")), "often")
    total = often.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    matched = stage(join_hot(found, often, ["anchor"], total), "matched")
    mixed = matched.filter("mixed")
    groups = mixed.groupBy("anchor", "c1", "c2").agg(F.sum("k").alias("times"), F.count(F.lit(1)).alias("n"), F.min(F.struct("t1", "t2", "place")).alias("one"))
    groups = stage(groups.select("anchor", "c1", "c2", "n", "times", "one.*"), "groups")
    again = join_hot(mixed.filter("k = 1").select("anchor", "c1", "c2", "t1", "t2", "place"), groups.filter("times > 1").select("anchor", "c1", "c2", "n", F.lit(True).alias("repeated")), ["anchor", "c1", "c2"], total)
    first = F.shiftright("place", 16)
    whole = matched.filter("NOT mixed AND k = 1").select("t1", "t2", "place").union(again.select("t1", "t2", "place"))
    whole = whole.select("t1", "t2", first.alias("first"), (first + F.shiftright("place", 8).bitwiseAND(F.lit(255)) + LENGTH).alias("last"))

    wanted = groups.groupBy("t1", "t2").agg(F.collect_list(F.struct("anchor", F.col("times").alias("n"), "place")).alias("wanted"))  # bounded by the text
    fetched = stage(_fetch(unique.select("t1", "t2", "packed").join(wanted, ["t1", "t2"])), "fetched")
    for part in _solve_groups(fetched):
        whole = whole.union(part)
    return whole


def merge(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted disjoint, non-touching ranges with the same bytes."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


_CLEANED = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"


def remove_repeats(docs: DataFrame, with_bytes: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256 and the kept bytes, one row per input row.

    Null text counts as empty; texts shorter than LENGTH stay whole; repeated rows repeat each
    other's strings and so lose them; very long texts are worked on in pieces; null doc_ids are
    allowed; extra columns are ignored; an empty table gives an empty result. ``kept`` is null
    unless asked for.
    """
    rows = stage(compressed(ids_and_text(docs)), "packed")
    long = rows.filter(F.col("n_bytes") >= LENGTH)
    # rows of one text are combined before the shuffle; an only row keeps its doc_id
    unique = stage(long.groupBy("t1", "t2").agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("doc_id"), F.min("n_bytes").alias("n_bytes"), F.first("packed").alias("packed")).withColumn("k", F.least(F.lit(2).cast("long"), F.col("copies"))), "unique")
    by_text = repeated_ranges(unique).distinct().groupBy(F.col("t1").alias("r1"), F.col("t2").alias("r2")).agg(F.collect_list(F.struct("first", "last")).alias("ranges"))  # bounded by the text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            out = []
            for doc_id, data, ranges in zip(*batch.columns, strict=True):
                data = unpack(data.as_py())
                gone = merge([(r["first"], r["last"]) for r in ranges.as_py() or []])
                at, kept = 0, []
                for a, b in gone:
                    kept.append(data[at:a])
                    at = b
                left = b"".join([*kept, data[at:]])
                out.append((doc_id.as_py(), len(data), len(data) - len(left), len(gone), hashlib.sha256(left).hexdigest(), left if with_bytes else None))
            yield batch_of(_CLEANED, list(zip(*out, strict=True)) or [()] * 6)

    joined = unique.filter("copies = 1").join(by_text, (F.col("t1") == F.col("r1")) & (F.col("t2") == F.col("r2")), "left")
    single = joined.select("doc_id", "packed", "ranges").mapInArrow(trimmed(run), _CLEANED)
    zero, empty = F.lit(0).cast("long"), F.lit(b"") if with_bytes else F.lit(None).cast("binary")
    short = rows.filter(F.col("n_bytes") < LENGTH).select("doc_id", "n_bytes", zero.alias("n_removed"), zero.alias("n_spans"), F.col("sha").alias("kept_sha256"), (F.col("packed") if with_bytes else empty).alias("kept"))
    several = unique.filter("copies > 1").select("t1", "t2", F.col("copies").alias("n"), F.lit(True).alias("gone"))
    copies = join_hot(long.select("doc_id", "t1", "t2", "n_bytes"), several, ["t1", "t2"], rows.count())
    lost = copies.select("doc_id", "n_bytes", F.col("n_bytes").alias("n_removed"), F.lit(1).cast("long").alias("n_spans"), F.lit(hashlib.sha256(b"").hexdigest()).alias("kept_sha256"), empty.alias("kept"))
    return single.union(lost).union(short)
