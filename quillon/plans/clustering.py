"""Hard clustering: k-means-style local search and repeated bisection on the sum of composite norms.

The search is driven from small per-group tables; all work on documents and features is
DataFrame joins and aggregations, for all groups of a pass at once.
"""

from __future__ import annotations

import hashlib
import heapq
import itertools
import logging
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from quillon.functions.rand import DEFAULT_SEED, SCALE, hash_rand
from quillon.operators.cluster import choose_smartly, section, seed_weight
from quillon.operators import refine as rf
from quillon.operators.refine import EPSILON, best_moves, wide_composite, wide_norms
from quillon.plans.iteration import cut, small, stage

PASSES = 30
#: A group of about this size in memory is searched inside one task; a cell takes 8 bytes a part at most and 150 for its columns and their copies (less if packed).
LOCAL_BYTES = 1_000_000_000
#: Bytes of a packed cell where most of a group's cells are not 0 and it is held as a matrix.
DENSE_BYTES = 50
#: Below a larger cluster a search to a limit goes on in other tasks, a cluster each.
SHARED_CELLS = 2_000_000
#: Cells of a partition of packed vectors.
PACKED_CELLS = 500_000
#: Composites of at most this many numbers that are not 0 are held at once in a search with a job a pass; a bound is known beforehand, most have far fewer.
COMPOSITE_CELLS = 25_000_000
LOG = logging.getLogger("quillon")
#: A cluster of the bisection tree has its path as number (children 2p and 2p + 1); those below this have running numbers.
DEEPEST = 1 << 60


def most_cells(k: int) -> int:
    """The largest group that is searched for k parts inside one task."""
    return LOCAL_BYTES // (8 * k + 150)


@dataclass
class Group:
    """Unit vectors in memory, by document and feature: a document's cells start at its place in ``starts``.

    A group with at least every second cell of its documents and features is held as a matrix w, without starts and codes.
    ``rest`` has the squares of a document's cells that no other document shares: they count in norms, and in products of the document with itself alone.
    """

    ords: np.ndarray
    starts: np.ndarray | None
    codes: np.ndarray | None
    w: np.ndarray
    rest: np.ndarray

    @classmethod
    def of(cls, pdf: pd.DataFrame) -> Group:
        """Rows (ord, f, w) of a group; a document without features has one cell of weight 0."""
        ords, f, w = (pdf[c].to_numpy() for c in ("ord", "f", "w"))
        order = np.lexsort((f, ords))
        ords, starts = np.unique(ords[order], return_index=True)
        return cls(ords, starts, np.unique(f[order], return_inverse=True)[1].astype(np.int32), w[order], np.zeros(len(ords)))

    @classmethod
    def packed(cls, rows: pa.Table) -> Group:
        """Rows of ``Packed``, 12 bytes a shared cell."""

        def flat(name: str, dtype: type) -> tuple[np.ndarray, np.ndarray]:
            data, sizes = [], []
            for x in rows[name].chunks:
                ends = np.frombuffer(x.buffers()[1], np.int32)[x.offset : x.offset + len(x) + 1]
                data.append(np.frombuffer(x.buffers()[2], np.uint8)[ends[0] : ends[-1]].view(dtype))
                sizes.append(np.diff(ends) // np.dtype(dtype).itemsize)
            return np.concatenate(data), np.concatenate(sizes).astype(np.int64)

        ords, rest, (codes, sizes), (w, _) = rows["ord"].to_numpy(), rows["rest"].to_numpy(), flat("codes", np.int32), flat("w", np.float64)
        order, starts = ords.argsort(), np.cumsum(sizes) - sizes
        if (order[1:] < order[:-1]).any():
            placed = np.cumsum(sizes[order]) - sizes[order]
            cells = np.repeat(starts[order] - placed, sizes[order]) + np.arange(len(w))
            ords, starts, codes, w, rest = ords[order], placed, codes[cells], w[cells], rest[order]
        return cls(ords, starts, codes, w, rest)

    def __post_init__(self) -> None:
        if self.codes is not None:
            self.sizes = np.diff(self.starts, append=len(self.w))
            self.width = int(self.codes.max()) + 1
            if len(self.ords) * self.width <= 2 * len(self.w):
                self._fill()
        if self.codes is None:
            self.width = self.w.shape[1]
            self.own = np.einsum("ij,ij->i", self.w, self.w) + self.rest
        else:
            self.own = np.add.reduceat(self.w * self.w, self.starts) + self.rest

    def _fill(self) -> None:
        """Make the matrix, unless a document has a feature twice."""
        up = self.codes[1:] > self.codes[:-1]
        up[self.starts[1:] - 1] = True
        if up.all():
            full, shape = len(self.w) == len(self.ords) * self.width, (len(self.ords), self.width)
            if not full:
                self.w = np.bincount(np.repeat(np.arange(shape[0]) * shape[1], self.sizes) + self.codes, self.w, shape[0] * shape[1])
            self.w, self.codes, self.starts = self.w.reshape(shape), None, None

    def take(self, mask: np.ndarray) -> Group:
        if self.codes is None:
            return Group(self.ords[mask], None, None, self.w[mask], self.rest[mask])
        cells, sizes = np.repeat(mask, self.sizes), self.sizes[mask]
        seen = np.zeros(self.width, np.int32)
        codes = self.codes[cells]
        seen[codes] = 1
        return Group(self.ords[mask], np.cumsum(sizes) - sizes, (np.cumsum(seen, dtype=np.int32) - 1)[codes], self.w[cells], self.rest[mask])

    def dots(self, x: np.ndarray) -> np.ndarray:
        """Inner products of all documents with one vector of shared cells; alike for equal documents."""
        if self.codes is None:
            return np.einsum("ij,j->i", self.w, x[: self.width])
        return np.add.reduceat(x[self.codes] * self.w, self.starts)

    def similar(self, row: int) -> np.ndarray:
        """Inner products of all documents with that of the row."""
        if self.codes is None:
            x = self.w[row]
        else:
            cells, x = slice(self.starts[row], self.starts[row] + self.sizes[row]), np.zeros(self.width)
            x[self.codes[cells]] = self.w[cells]
        out = self.dots(x)
        out[row] += self.rest[row]
        return out

    def rand(self, seed: int, tag: str) -> np.ndarray:
        """``hash_rand`` of the documents."""
        start = hashlib.md5(f"{seed}|{tag}|".encode())

        def one(ord_: int) -> int:
            h = start.copy()
            h.update(str(ord_).encode())
            return int.from_bytes(h.digest()[:4], "big")

        return (np.array([one(o) for o in self.ords.tolist()], float) + 0.5) / SCALE

    def composites(self, child: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Composites of the parts, a row each, and their norms."""
        if self.codes is None:
            sums = np.stack([self.total(child == j) for j in range(k)])
        else:
            sums = np.bincount(np.repeat(child * self.width, self.sizes) + self.codes, self.w, k * self.width).reshape(k, -1)
        return sums, np.sqrt(np.array([row @ row for row in sums]) + np.bincount(child, self.rest, k))

    def whole(self, sums: np.ndarray) -> float:
        """Norm of the composite of all documents, given those of the parts."""
        both = sums.sum(axis=0)
        return float(np.sqrt(both @ both + self.rest.sum()))

    def total(self, mask: np.ndarray) -> np.ndarray:
        """Sum of the documents of the mask, which are a matrix."""
        return np.einsum("i,ij->j", mask.astype(float), self.w)

    def cells(self, row: int) -> tuple[bytes, bytes, float]:
        """Codes and weights of a document, and its rest."""
        if self.codes is None:
            return np.arange(self.width, dtype=np.int32).tobytes(), self.w[row].tobytes(), float(self.rest[row])
        mine = slice(self.starts[row], self.starts[row] + self.sizes[row])
        return self.codes[mine].tobytes(), self.w[mine].tobytes(), float(self.rest[row])

    def keyed(self, mask: np.ndarray, part: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Cells of the documents of the mask, by part and code as one number (part * width + code)."""
        if self.codes is None:
            codes, w, sizes = np.tile(np.arange(self.width), int(mask.sum())), self.w[mask].ravel(), self.width
        else:
            cells = np.repeat(mask, self.sizes)
            codes, w, sizes = self.codes[cells], self.w[cells], self.sizes[mask]
        return np.repeat(part[mask] * width, sizes) + codes, w

    def moves(self, child: np.ndarray, sums: np.ndarray, norms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Every document's best other part and the gain of moving it there."""
        rows, dots, squares = np.arange(len(self.ords)), np.stack([self.dots(row) for row in sums], axis=1), norms * norms
        dots[rows, child] += self.rest
        leave = np.sqrt(np.maximum(0.0, squares[child] + self.own - 2 * dots[rows, child])) - norms[child]
        gains = np.round(leave[:, None] + np.sqrt(np.maximum(0.0, squares + self.own[:, None] + 2 * dots)) - norms, 12)
        gains[rows, child] = -np.inf
        return gains.argmax(axis=1), gains.max(axis=1)

    def refine(self, child: np.ndarray, k: int, passes: int) -> np.ndarray:
        """The passes of ``refine``; one set of composites is held at a time."""
        child = child.astype(np.int64)
        sums, norms = self.composites(child, k)
        for _ in range(passes):
            to, best = self.moves(child, sums, norms)
            tried = np.where(best > EPSILON, to, child)
            del sums
            sums, new = self.composites(tried, k)
            if new.sum() < norms.sum() - EPSILON:
                tried = child.copy()
                tried[best.argmax()] = to[best.argmax()]
                del sums
                sums, new = self.composites(tried, k)
            rose = new.sum() > norms.sum() + EPSILON
            if new.sum() > norms.sum():
                child, norms = tried, new
            if not rose:
                break
        return child

    def split(self, path: int, seed: int, passes: int, second: np.ndarray) -> np.ndarray:
        """Child (0 or 1) of every document, as ``split_groups`` finds them; second: the documents' numbers for the second seed."""
        if len(self.ords) < 2:
            return np.zeros(len(self.ords), np.int64)
        near = self.similar(int(self.rand(seed, f"first|{path}").argmin()))
        closer = self.similar(int(race(near, second).argmin()))
        return self.refine(np.round(closer, 9) > np.round(near, 9), 2, passes)


def race(near: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Times of the race for the second seed, by similarity to the first and the documents' numbers."""
    away = 1.0 - near
    return np.where(away > 1e-12, -np.log(second) / np.where(away > 1e-12, away, 1.0), 1e300)


def refine_group(pdf: pd.DataFrame, k: int, passes: int) -> pd.DataFrame:
    """The passes of ``refine`` over one group's rows (ord, child, f, w), in memory."""
    group = Group.of(pdf)
    start = pdf.drop_duplicates("ord").sort_values("ord")["child"].to_numpy()
    return pd.DataFrame({"ord": group.ords, "to": group.refine(start, k, passes).astype("int32")})


def split_group(pdf: pd.DataFrame, seed: int, passes: int) -> pd.DataFrame:
    group = Group.of(pdf)
    child = group.split(int(pdf["grp"].iloc[0]), seed, passes, group.rand(seed, "second"))
    return pd.DataFrame({"ord": group.ords, "grp": pdf["grp"].iloc[0], "child": child.astype("int32")})


def kmeans_group(pdf: pd.DataFrame, n: int, seed: int, passes: int) -> pd.DataFrame:
    """Seeds, assignment and refinement of ``kmeans`` over all documents (ord, f, w), in memory."""
    group = Group.of(pdf)
    near = [group.similar(int(group.rand(seed, "smart-0").argmin()))]
    closest = np.maximum(0.0, 1.0 - near[0])
    for i in range(1, n):
        race = np.where(closest > 1e-12, -np.log(group.rand(seed, f"smart-{i}")) / np.where(closest > 1e-12, closest, 1.0), np.inf)
        near.append(group.similar(int(race.argmin())))
        closest = np.maximum(0.0, np.minimum(closest, 1.0 - near[-1]))
    child = np.round(np.stack(near, axis=1), 9).argmax(axis=1)
    return pd.DataFrame({"ord": group.ords, "child": (group.refine(child, n, passes) if n > 1 else child).astype("int32")})


def tree_group(rows: pa.Table, n: int | None, limit: float | None, seed: int, passes: int, shared: int) -> pa.Table:
    """The best-first search below one cluster (grp, and the rows of ``Packed``) up to n leaves or while gains reach the limit, in memory.

    Rows with an ord give a document's deepest cluster (path); those without one a split
    (path, its gain and the sizes of both children). Clusters beyond the deepest number are not split,
    and without n nothing is below one of more than ``shared`` cells: its children are for other tasks.
    """
    root, whole = rows["grp"][0].as_py(), Group.packed(rows)
    del rows
    ords, second = whole.ords, whole.rand(seed, "second")
    at, splits, heap, held = np.full(len(ords), root), [], [], {}

    def push(path: int, group: Group, mine: np.ndarray) -> bool:
        gain, size = 0.0, len(mine)
        if size > 1:
            if not 0 < path < DEEPEST:
                return False
            child = group.split(path, seed, passes, second[mine])
            sums, norms = group.composites(child, 2)
            gain = round(float(norms.sum()) - group.whole(sums), 12)
            at[mine] = 2 * path + child
            splits.append((path, gain, size - int(child.sum()), int(child.sum())))
            if gain > EPSILON and (limit is None or gain >= limit):
                held[path] = group, mine, child
        heapq.heappush(heap, (-gain, path))
        return True

    known = push(root, whole, np.arange(len(ords))) and (n is not None or whole.w.size <= shared)
    del whole
    while known and (n is None or len(heap) < n) and heap[0][1] in held:
        path = heapq.heappop(heap)[1]  # its documents stand at its children
        group, mine, child = held.pop(path)
        parts = [(2 * path + c, group.take(child == c), mine[child == c]) if (child == c).any() else (2 * path + c, None, mine[:0]) for c in (0, 1)]
        del group
        while parts:
            known &= push(*parts.pop(0))
    made = [list(x) for x in zip(*splits, strict=True)] or [[], [], [], []]
    blank, none = np.zeros(len(ords), np.int64), len(splits)
    columns = (np.concatenate([at, np.array(made[0], np.int64)]), np.concatenate([np.zeros(len(ords)), made[1]]), *[np.concatenate([blank, np.array(x, np.int64)]) for x in made[2:]])
    return pa.table([pa.concat_arrays([pa.array(ords, pa.int64()), pa.nulls(none, pa.int64())]), *map(pa.array, columns)], ["ord", "path", "gain", "size0", "size1"])


@dataclass
class Packed:
    """Unit vectors as a row (ord, codes, w, rest) a document: the bytes of its features' int32 codes below width, and of its doubles.

    Features that only one document has need no code: the sum of their squares is its rest. A document without other features has
    one cell of weight 0. The driver may hold a composite and the documents of a cluster.
    """

    rows: DataFrame
    width: int
    #: The same in long form, as a plan, if it was not packed from that.
    u: DataFrame | None = None


#: Columns of ``Packed``.
PACKED = "ord long, codes binary, w binary, rest double"


def packed_table(docs: np.ndarray, ends: np.ndarray, codes: np.ndarray, w: np.ndarray, rest: np.ndarray) -> pa.Table:
    """Rows of ``Packed``; ends: where the cells of each document start, and the last end."""

    def binary(x: np.ndarray) -> pa.Array:
        return pa.Array.from_buffers(pa.binary(), len(docs), [None, pa.py_buffer((ends * x.itemsize).astype(np.int32)), pa.py_buffer(x)])

    return pa.table([pa.array(docs, pa.int64()), binary(codes), binary(w), pa.array(rest, pa.float64())], ["ord", "codes", "w", "rest"])


def pack_arrays(rows: DataFrame, u: DataFrame) -> Packed | None:
    """Unit vectors of rows (ord, x: an array with a feature a position), u in long form, without making a row a cell.

    None where ords are missing or repeated, or with more positions or documents than may be broadcast.
    """
    total, distinct, width = rows.agg(F.count(F.lit(1)), F.count_distinct("ord"), F.max(F.size("x"))).first()
    width = max(1, width or 1)
    if not total or distinct < total or max(total, 2 * width) > rf.BROADCAST_CELLS:
        return None
    step = max(1, PACKED_CELLS // width)

    def packs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), step):
                part = batch.slice(at, step)
                sizes = part["x"].value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
                x = part["x"].flatten().fill_null(0).to_numpy(zero_copy_only=False).astype(float)
                doc = np.repeat(np.arange(len(part)), sizes)
                code = np.arange(len(x)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                norm = np.sqrt(np.bincount(doc, x * x, len(part)))[doc]
                real = x != 0
                w = np.divide(x, norm, out=np.zeros(len(x)), where=norm != 0)[real]
                doc, code = doc[real], code[real]
                bare = np.setdiff1d(np.arange(len(part)), doc)
                places = np.searchsorted(doc, bare)
                doc, code, w = (np.insert(a, places, b) for a, b in ((doc, bare), (code, 0), (w, 0.0)))
                ends = np.searchsorted(doc, np.arange(len(part) + 1))
                yield from packed_table(part["ord"].to_numpy(), ends, code.astype(np.int32), w, np.zeros(len(part))).to_batches()

    dealt = rows.repartition(total * width // PACKED_CELLS + 1, "ord")
    return Packed(stage(dealt.mapInArrow(packs, PACKED), "packed"), width, u)


def pack(u: DataFrame, docs: DataFrame, k: int = 2) -> Packed | None:
    """The vectors of all docs; None with more documents, shared features or cells of k composites than may be broadcast, or with documents without ord."""
    both = u.select("ord", F.xxhash64("feature").alias("f"), "w").union(docs.select("ord", F.lit(None).cast("long"), F.lit(None).cast("double")))
    cells, total, named = both.agg(F.count("f"), F.count(F.when(F.col("f").isNull(), 1)), F.count("ord")).first()
    if total > rf.BROADCAST_CELLS or named < cells + total:
        return None
    most = rf.BROADCAST_CELLS
    shares = u.groupBy(F.xxhash64("feature").alias("f")).count().filter("count > 1").select("f", F.least("count", F.lit(k)).alias("n")).limit(most + 1).toArrow()
    table = np.sort(shares["f"].to_numpy())
    if len(table) > most or shares["n"].to_numpy().sum() > COMPOSITE_CELLS:
        return None
    shared = u.sparkSession.sparkContext.broadcast(table)

    def packs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = list(batches)
        if not got:
            return
        cells, table = pa.Table.from_batches(got), shared.value
        real = cells["f"].is_valid().to_numpy()
        docs = np.unique(cells["ord"].to_numpy()[~real])
        cells = cells.filter(pa.array(real))
        ords, f, w = (cells[c].to_numpy() for c in ("ord", "f", "w"))
        mine = np.isin(ords, docs)
        ords, f, w = ords[mine], f[mine], w[mine]
        codes = np.minimum(np.searchsorted(table, f), max(0, len(table) - 1))
        common = table[codes] == f if len(table) else np.zeros(len(f), bool)
        rest = np.bincount(np.searchsorted(docs, ords[~common]), w[~common] ** 2, len(docs))
        bare = np.setdiff1d(docs, ords[common])
        ords, w = np.concatenate([ords[common], bare]), np.concatenate([w[common], np.zeros(len(bare))])
        codes = np.concatenate([codes[common], np.zeros(len(bare), np.int64)]).astype(np.int32)
        order = np.lexsort((codes, ords))
        ends = np.append(np.searchsorted(ords[order], docs), len(ords))
        yield from packed_table(docs, ends, codes[order], w[order], rest).to_batches(max_chunksize=10_000)

    parts = (cells + total) // PACKED_CELLS + 1
    rows = stage(both.repartition(parts, "ord").mapInArrow(packs, PACKED), "packed")
    shared.destroy()
    return Packed(rows, max(1, len(table)))


#: What the tasks of ``Search`` give: sums by slice of the keys (keys, values); below 0, a best document (its number, ord, part and cells), numbers of documents (places, numbers), and what the parts' rests change by.
SUMS = "slice int, value double, ord long, part int, codes binary, w binary, rest double"
BEST, NUMBERS, RESTS = -1, -2, -3


def told(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.float64(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.float64())
    return pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["slice", "value", "ord", "part", "codes", "w", "rest"])


def summed(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The keys in order, once each, and the sums of their values."""
    if not len(keys):
        return keys, values
    order = keys.argsort(kind="stable")
    keys = keys[order]
    starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    return keys[starts], np.add.reduceat(values[order], starts)


def sliced(keys: np.ndarray, values: np.ndarray, step: int) -> list[tuple]:
    """Rows of the sums by slice, of keys in order."""
    slices = keys // step
    starts = np.flatnonzero(np.append(True, slices[1:] != slices[:-1])) if len(keys) else []
    return [(int(slices[a]), 0.0, 0, 0, keys[a:b].tobytes(), values[a:b].tobytes(), 0.0) for a, b in itertools.pairwise([*starts, len(keys)])]


@dataclass
class Composites:
    """Composites of the parts: their cells that are not 0, by part and code (part * width + code) in order. Its items are full vectors, made when asked for."""

    k: int
    width: int
    keys: np.ndarray
    values: np.ndarray

    def __iter__(self) -> Iterator[np.ndarray]:
        for j, mine in enumerate(self.parts()):
            x = np.zeros(self.width)
            x[self.keys[mine] - j * self.width] = self.values[mine]
            yield x

    def parts(self) -> list[slice]:
        return [slice(a, b) for a, b in itertools.pairwise(np.searchsorted(self.keys, np.arange(self.k + 1) * self.width).tolist())]

    def plus(self, keys: np.ndarray, values: np.ndarray) -> Composites:
        keys, values = summed(np.concatenate([self.keys, keys]), np.concatenate([self.values, values]))
        real = values != 0
        return Composites(self.k, self.width, keys[real], values[real])

    def norms(self, rests: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(0.0, np.array([self.values[mine] @ self.values[mine] for mine in self.parts()]) + rests))

    def whole(self, rests: np.ndarray) -> float:
        """Norm of the sum of all parts."""
        both = np.bincount(self.keys % self.width, self.values, self.width)
        return float(np.sqrt(both @ both + rests.sum()))


@dataclass
class Vector:
    """A document as ``Packed`` has it."""

    ord: int
    codes: bytes
    w: bytes
    rest: float

    def near(self, group: Group, width: int) -> np.ndarray:
        """Inner products of the group's documents with it."""
        out = group.dots(np.bincount(np.frombuffer(self.codes, np.int32), np.frombuffer(self.w, np.float64), width))
        out[group.ords == self.ord] += self.rest
        return out


class Search:
    """The passes over the documents (ords, ascending) of one cluster that fits no task, a job each.

    Tasks stream over packed documents and give sums over those that move, added up by slices of
    part and code before the driver sees them; the driver holds the parts' composites, and the
    documents' numbers and parts.
    """

    def __init__(self, packed: Packed, ords: np.ndarray, k: int, seed: int) -> None:
        self.packed, self.ords, self.k, self.seed = packed, ords, k, seed
        self.sc = packed.rows.sparkSession.sparkContext
        self.step = max(1, -(-k * packed.width // (2 * self.sc.defaultParallelism)))
        self.members = self.sc.broadcast(ords)

    def _ran(self, values: tuple, task: Callable[[Iterator[tuple[Group, np.ndarray]], tuple], Iterator[pa.RecordBatch]], add: bool = True) -> list[tuple]:
        """What the tasks say of their documents, which they get a batch at a time with their places in the cluster."""
        shared, members, step = self.sc.broadcast(values), self.members, self.step

        def each(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Group, np.ndarray]]:
            for batch in batches:
                own = batch["ord"].to_numpy()
                at = np.minimum(np.searchsorted(members.value, own), len(members.value) - 1)
                mine = members.value[at] == own
                if mine.any():
                    group = Group.packed(pa.Table.from_batches([batch]).filter(pa.array(mine)))
                    yield group, np.searchsorted(members.value, group.ords)

        def added(key: tuple, rows: pa.Table) -> pa.Table:
            if key[0].as_py() < 0:
                return rows
            low, sums = key[0].as_py() * step, np.zeros(step)
            for keys, values in zip(rows["codes"].to_pylist(), rows["w"].to_pylist(), strict=True):
                sums[np.frombuffer(keys, np.int64) - low] += np.frombuffer(values, np.float64)
            places = np.flatnonzero(sums)
            return pa.Table.from_batches([told([(key[0].as_py(), 0.0, 0, 0, (places + low).tobytes(), sums[places].tobytes(), 0.0)])])

        out = self.packed.rows.mapInArrow(lambda batches: task(each(batches), shared.value), SUMS)
        rows = (out.groupBy("slice").applyInArrow(added, SUMS) if add else out).toArrow()
        shared.destroy()
        return list(zip(*[rows[c].to_pylist() for c in rows.column_names], strict=True))

    def first(self, tag: str) -> Vector:
        """The document of the smallest random number."""
        start = Group(self.ords, np.arange(len(self.ords)), np.zeros(len(self.ords), np.int32), np.zeros(len(self.ords)), np.zeros(len(self.ords)))
        row = self.packed.rows.filter(F.col("ord") == int(self.ords[start.rand(self.seed, tag).argmin()])).first()
        return Vector(row["ord"], bytes(row["codes"]), bytes(row["w"]), row["rest"])

    def drawn(self, last: Vector, tag: str, closest: np.ndarray | None = None) -> tuple[Vector, np.ndarray]:
        """The next seed of a weighted race, and the documents' smallest distances, given the last seed and those to the seeds before."""
        width, seed, none = self.packed.width, self.seed, 1e300 if closest is None else np.inf

        def draw(groups: Iterator[tuple[Group, np.ndarray]], shared: tuple) -> Iterator[pa.RecordBatch]:
            last, closest = shared
            for group, at in groups:
                away = 1.0 - last.near(group, width)
                if closest is not None:
                    away = np.maximum(0.0, np.minimum(closest[at], away))
                times = np.where(away > 1e-12, -np.log(group.rand(seed, tag)) / np.where(away > 1e-12, away, 1.0), none)
                row = int(times.argmin())
                codes, w, rest = group.cells(row)
                yield told([(BEST, float(times[row]), int(group.ords[row]), 0, codes, w, rest), (NUMBERS, 0.0, 0, 0, at.tobytes(), away.tobytes(), 0.0)])

        rows = self._ran((last, closest), draw, add=False)
        out = np.zeros(len(self.ords))
        for kind, _, _, _, at, away, _ in rows:
            if kind == NUMBERS:
                out[np.frombuffer(at, np.int64)] = np.frombuffer(away, np.float64)
        best = min((r for r in rows if r[0] == BEST), key=lambda r: r[1:3])
        return Vector(best[2], *best[4:]), out

    def refined(self, seeds: list[Vector], passes: int) -> tuple[np.ndarray, np.ndarray, float]:
        """Part of every document, the parts' norms and that of the whole, from the nearest seeds on: ``Group.refine``."""
        width, k, step = self.packed.width, self.k, self.step

        def said(group: Group, at: np.ndarray, goes: np.ndarray, to: np.ndarray, child: np.ndarray | None) -> pa.RecordBatch:
            keys, values = group.keyed(goes, to, width)
            rests = np.bincount(to[goes], group.rest[goes], k)
            if child is not None:
                left, lost = group.keyed(goes, child, width)
                keys, values = np.concatenate([keys, left]), np.concatenate([values, -lost])
                rests -= np.bincount(child[goes], group.rest[goes], k)
            return told([*sliced(*summed(keys, values), step), (NUMBERS, 0.0, 0, 0, at[goes].tobytes(), to[goes].astype(np.int32).tobytes(), 0.0), (RESTS, 0.0, 0, 0, None, rests.tobytes(), 0.0)])

        def begin(groups: Iterator[tuple[Group, np.ndarray]], shared: tuple) -> Iterator[pa.RecordBatch]:
            for group, at in groups:
                to = np.round(np.stack([x.near(group, width) for x in shared], axis=1), 9).argmax(axis=1)
                yield said(group, at, np.ones(len(at), bool), to, None)

        def move(groups: Iterator[tuple[Group, np.ndarray]], shared: tuple) -> Iterator[pa.RecordBatch]:
            (child, sums, norms), best = shared, None
            for group, at in groups:
                own = child[at].astype(np.int64)
                to, gains = group.moves(own, sums, norms)
                row = int(gains.argmax())
                if best is None or (-gains[row], group.ords[row]) < (-best[1], best[2]):
                    best = (BEST, float(gains[row]), int(group.ords[row]), int(to[row]), *group.cells(row))
                if (goes := gains > EPSILON).any():
                    yield said(group, at, goes, to, own)
            if best:
                yield told([best])

        def read(rows: list[tuple]) -> tuple[np.ndarray, ...]:
            """Places and new parts of the documents that move, and what that adds to the composites (keys, values) and rests."""
            at, to, keys, values, rests = [np.zeros(0, np.int64)], [np.zeros(0, np.int32)], [np.zeros(0, np.int64)], [np.zeros(0)], np.zeros(k)
            for kind, _, _, _, codes, w, _ in rows:
                if kind >= 0:
                    keys.append(np.frombuffer(codes, np.int64))
                    values.append(np.frombuffer(w, np.float64))
                elif kind == NUMBERS:
                    at.append(np.frombuffer(codes, np.int64))
                    to.append(np.frombuffer(w, np.int32))
                elif kind == RESTS:
                    rests += np.frombuffer(w, np.float64)
            return *map(np.concatenate, (at, to, keys, values)), rests

        child, sums = np.zeros(len(self.ords), np.int32), Composites(k, width, np.zeros(0, np.int64), np.zeros(0))
        at, to, keys, values, rests = read(self._ran(tuple(seeds), begin))
        child[at], sums = to, sums.plus(keys, values)
        norms = sums.norms(rests)
        for _ in range(passes):
            rows = self._ran((child, sums, norms), move)
            at, to, keys, values, change = read(rows)
            tried = sums.plus(keys, values)
            new = tried.norms(rests + change)
            if new.sum() < norms.sum() - EPSILON:
                _, _, one, part, codes, w, rest = min((r for r in rows if r[0] == BEST), key=lambda r: (-r[1], r[2]))
                at, to = np.array([np.searchsorted(self.ords, one)]), np.array([part], np.int32)
                codes, w, old = np.frombuffer(codes, np.int32).astype(np.int64), np.frombuffer(w, np.float64), int(child[at[0]])
                tried = sums.plus(np.concatenate([part * width + codes, old * width + codes]), np.concatenate([w, -w]))
                change = np.bincount([part, old], [rest, -rest], k)
                new = tried.norms(rests + change)
            rose = new.sum() > norms.sum() + EPSILON
            if new.sum() > norms.sum():
                child[at], sums, norms, rests = to, tried, new, rests + change
            if not rose:
                break
        self.members.destroy()
        return child, norms, sums.whole(rests)


def split_packed(packed: Packed, ords: np.ndarray, path: int, seed: int, passes: int) -> tuple[np.ndarray, float]:
    """Child of every document (ords, ascending) of one cluster and the split's gain: ``Group.split`` with a job a pass."""
    search = Search(packed, ords, 2, seed)
    first = search.first(f"first|{path}")
    second, _ = search.drawn(first, "second")
    child, norms, whole = search.refined([first, second], passes)
    return child, round(float(norms.sum()) - whole, 12)


def kmeans_packed(packed: Packed, ords: np.ndarray, n: int, seed: int, passes: int) -> DataFrame:
    """(ord, child) of all documents (ords, ascending): ``kmeans_group`` with a job a seed and a pass."""
    search = Search(packed, ords, n, seed)
    seeds, closest = [search.first("smart-0")], np.ones(len(ords)) * np.inf
    for i in range(1, n):
        found, closest = search.drawn(seeds[-1], f"smart-{i}", closest)
        seeds.append(found)
    child = search.refined(seeds, passes if n > 1 else 0)[0]
    shared = packed.rows.sparkSession.sparkContext.broadcast((ords, child))

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, part = shared.value
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch["ord"], pa.array(part[np.searchsorted(known, batch["ord"].to_numpy())], pa.int32())], ["ord", "child"])

    return packed.rows.select("ord").mapInArrow(parts, "ord long, child int")


def cells_of(u: DataFrame, members: DataFrame) -> DataFrame:
    """Rows (.., f, w) of all members (ord, ..), a cell of weight 0 for those without features."""
    cells = members.join(u, "ord", "left")
    return cells.select(*members.columns, F.xxhash64("feature").alias("f"), F.coalesce("w", F.lit(0.0)).alias("w"))


def refine(u: DataFrame, state: DataFrame, k: int, passes: int = PASSES, local_cells: int | None = None) -> DataFrame:
    """State (ord, grp, child) after at most ``passes`` passes of moves, for groups of any size alike.

    A pass moves every document whose best move gains against the composites as they are. A
    group keeps that only if its objective rose; otherwise just its single best move is made,
    which always gains. The search ends when the objective no longer rises, so when no move
    gains. Documents without features never move. Groups whose counted cells fit a task run
    their passes there, all in one job; larger ones run the same passes distributed. Only the
    place differs, not the moves.
    """
    state = cut(state)
    most = most_cells(k) if local_cells is None else local_cells // k
    cells = cut(u.join(state, "ord").groupBy("grp").count())  # a row per group
    fits, large = cells.filter(F.col("count") <= most).select("grp"), cells.filter(F.col("count") > most).select("grp")
    if fits.isEmpty():
        return refine_large(u, state, k, passes)
    rows = u.join(state.join(small(fits), "grp"), "ord").select("ord", "grp", "child", F.xxhash64("feature").alias("f"), "w")
    moved = rows.groupBy("grp").applyInPandas(lambda pdf: refine_group(pdf, k, passes), "ord long, to int")
    done = cut(state.join(moved, "ord", "left").select("ord", "grp", F.coalesce("to", F.col("child").cast("int")).alias("child")))
    if large.isEmpty():
        return done
    rest = refine_large(u, state.join(small(large), "grp", "left_semi").select("ord", "grp", "child"), k, passes)
    return done.join(small(large), "grp", "left_anti").select("ord", "grp", "child").union(rest.select("ord", "grp", F.col("child").cast("int")))


def refine_large(u: DataFrame, state: DataFrame, k: int, passes: int = PASSES) -> DataFrame:
    """The distributed passes of ``refine``: a job for the new state and one for its composites and norms each; the driver holds one number per group."""

    def measured(state: DataFrame) -> tuple[DataFrame, DataFrame, dict[int, float]]:
        comp = wide_composite(u, state, k).persist()  # one step from the checkpointed state, so losing it is cheap
        norms = wide_norms(comp, k)
        return comp, norms, {r["grp"]: r["total"] for r in norms.select("grp", "total").collect()}

    state = cut(state)
    comp, norms, totals = measured(state)
    for _ in range(passes):
        moves = best_moves(u, state, comp, norms, k).filter(F.col("gain") > EPSILON)
        tried = cut(state.join(moves.select("ord", "to"), "ord", "left").select("ord", "grp", F.coalesce("to", "child").alias("child")))
        new_comp, new_norms, new_totals = measured(tried)
        worse = [g for g, t in totals.items() if new_totals.get(g, 0.0) < t - EPSILON]
        if worse:
            bad = small(u.sparkSession.createDataFrame([(g, True) for g in worse], "grp long, bad boolean"))
            one = moves.join(bad, "grp").groupBy("grp").agg(F.max(F.struct("gain", (-F.col("ord")).alias("o"), "to")).alias("m"))
            single = one.select((-F.col("m.o")).alias("ord"), F.col("m.to").alias("one"))
            both = tried.withColumnRenamed("child", "tried").join(state.select("ord", "child"), "ord").join(bad, "grp", "left").join(single, "ord", "left")
            new_comp.unpersist()
            tried = cut(both.select("ord", "grp", F.when(F.col("bad").isNull(), F.col("tried")).otherwise(F.coalesce("one", "child")).alias("child")))
            new_comp, new_norms, new_totals = measured(tried)
        rose = any(t > totals.get(g, 0.0) + EPSILON for g, t in new_totals.items())
        if sum(new_totals.values()) > sum(totals.values()):
            comp.unpersist()
            state, comp, norms, totals = tried, new_comp, new_norms, new_totals
        if not rose:
            break
    comp.unpersist()
    return state


def kmeans(u: DataFrame, docs: DataFrame, n: int, seed: int = DEFAULT_SEED, passes: int = PASSES) -> DataFrame:
    """(ord, cluster_id): n seeds, assignment to the nearest, one refinement; empty if n exceeds the documents.

    Cluster ids are 1-based in seed order and count non-empty clusters only.
    """
    total = docs.count()
    if total < n:
        return docs.select("ord", F.lit(0).cast("long").alias("cluster_id")).limit(0)
    if 0 < u.count() + total <= most_cells(n):
        rows = cells_of(u, docs.select("ord"))
        return _numbered(cut(rows.groupBy().applyInPandas(lambda pdf: kmeans_group(pdf, n, seed, passes), "ord long, child int")))
    start = section(u, docs, choose_smartly(u, docs, n, seed))
    state = refine(u, start.select("ord", F.lit(0).cast("long").alias("grp"), F.col("cluster_id").cast("int").alias("child")), n, passes) if n > 1 else start.withColumnRenamed("cluster_id", "child")
    return _numbered(state)


def _numbered(state: DataFrame) -> DataFrame:
    """(ord, cluster_id) of a state, non-empty parts numbered from 1."""
    used = sorted(r["child"] for r in state.select("child").distinct().collect())  # at most n
    ids = state.sparkSession.createDataFrame([(c, i) for i, c in enumerate(used, 1)], "child int, cluster_id long")
    return state.join(F.broadcast(ids), "child").select("ord", "cluster_id")


@dataclass
class Node:
    """A cluster of the bisection tree: its size and, once split, the gain of splitting it."""

    path: int
    size: int
    parent: int | None = None
    gain: float | None = None
    children: list[int] = field(default_factory=list)


def by_room(u: DataFrame, members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Groups (grp) of members (ord, grp) that fit a task when split in two, and those that don't."""
    counted = members.join(u.groupBy("ord").agg(F.count(F.lit(1)).alias("n")), "ord", "left").groupBy("grp").agg(F.sum(F.coalesce("n", F.lit(1))).alias("n"))
    cells = cut(counted)  # a row per group
    return cells.filter(F.col("n") <= most_cells(2)).select("grp"), cells.filter(F.col("n") > most_cells(2)).select("grp")


def split_groups(u: DataFrame, members: DataFrame, seed: int, passes: int) -> DataFrame:
    """(ord, grp, child): every group split in two by weighted seeding and refinement; groups of one stay child 0.

    All groups are split together: the first seed of a group is its smallest keyed random
    number, the second the winner of the weighted race, keyed by the group's path. Groups
    that fit a task are split there, all in one job.
    """
    fits, large = by_room(u, members)
    done = None
    if not fits.isEmpty():
        cells = cells_of(u, members.join(small(fits), "grp").select("ord", "grp"))
        done = cut(cells.groupBy("grp").applyInPandas(lambda pdf: split_group(pdf, seed, passes), "ord long, grp long, child int"))
        if large.isEmpty():
            return done
        members = members.join(small(large), "grp").select("ord", "grp")
    keyed = members.withColumn("r", hash_rand(seed, "first", F.col("grp"), F.col("ord")))
    first = keyed.groupBy("grp").agg(F.min(F.struct("r", "ord")).alias("m")).select("grp", F.col("m.ord").alias("seed0"))

    def sims(seeds: DataFrame, name: str) -> DataFrame:
        chosen = u.join(seeds, F.col("ord") == F.col(name)).select("grp", "feature", F.col("w").alias("x"))
        return u.join(members, "ord").join(chosen, ["grp", "feature"]).groupBy("ord").agg(F.sum(F.col("w") * F.col("x")).alias(f"sim_{name}"))

    near = members.join(sims(first, "seed0"), "ord", "left").withColumn("sim_seed0", F.coalesce("sim_seed0", F.lit(0.0)))
    near = cut(near)
    race = near.withColumn("race", seed_weight(F.lit(1.0) - F.col("sim_seed0"), seed, "second", F.col("ord")))
    second = race.groupBy("grp").agg(F.min(F.struct(F.coalesce("race", F.lit(1e300)).alias("race"), "ord")).alias("m")).select("grp", F.col("m.ord").alias("seed1"))
    both = near.join(sims(second, "seed1"), "ord", "left").withColumn("sim_seed1", F.coalesce("sim_seed1", F.lit(0.0)))
    child = F.when(F.round("sim_seed1", 9) > F.round("sim_seed0", 9), 1).otherwise(0)
    rest = refine(u, both.select("ord", "grp", child.alias("child")), 2, passes)
    return done.union(rest.select("ord", "grp", F.col("child").cast("int"))) if done is not None else rest


def shared_out(spark: SparkSession, loads: dict[int, int], most: int) -> tuple[DataFrame, int]:
    """(grp, slot) and the number of partitions: so that, dealt by slot, the groups' loads are spread over up to so many partitions evenly."""
    parts = min(len(loads), most)
    key, at = F.col("id").cast("int").alias("slot"), F.expr(f"pmod(hash(int(id)), {parts})").alias("at")
    keys = {r["at"]: r["slot"] for r in spark.range(64 * parts + 1000).select(key, at).groupBy("at").agg(F.min("slot").alias("slot")).collect()}
    heap, rows = [(0, slot) for slot in sorted(keys.values())], []
    for grp, load in sorted(loads.items(), key=lambda x: (-x[1], x[0])):
        taken, slot = heapq.heappop(heap)
        rows.append((grp, slot))
        heapq.heappush(heap, (taken + load, slot))
    return spark.createDataFrame(rows, "grp long, slot int"), parts


def moved_down(trail: DataFrame, path: int, ords: np.ndarray, child: np.ndarray) -> DataFrame:
    """The trail with the documents of one cluster (ords, ascending) at its children."""
    shared = trail.sparkSession.sparkContext.broadcast((ords, child))

    def down(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, part = shared.value
        for batch in batches:
            own, grp = batch["ord"].to_numpy(), batch["grp"].to_numpy()
            at = np.minimum(np.searchsorted(known, own), len(known) - 1)
            yield pa.RecordBatch.from_arrays([batch["ord"], pa.array(np.where(grp == path, 2 * path + part[at].astype(np.int64), grp))], ["ord", "grp"])

    return trail.select("ord", "grp").mapInArrow(down, "ord long, grp long")


def repeated_bisection(u: DataFrame | None, docs: DataFrame, n: int | None = None, limit: float | None = None, seed: int = DEFAULT_SEED, passes: int = PASSES, packed: Packed | None = None) -> DataFrame:
    """(ord, cluster_id): best-first bisection until n clusters, or while the best gain reaches the limit, however many clusters that makes.

    The split of a cluster depends on its members and path only, so each round splits every
    unsplit cluster of the tree that the search can reach in one job; the driver then replays the best-first search on
    the gains (a heap of at most one entry per cluster). Clusters are numbered from 1 by
    ascending split gain, then path; clusters without documents are not counted. n wins over
    limit; a best gain of at most 1e-12 always stops. Given the vectors ``packed`` too, the
    search below a cluster that fits a task is done there, and larger ones are split from them; u may
    then be None if they hold it.
    """
    if n is None and limit is None:
        raise ValueError("give n or limit")
    if n is not None:
        limit = None
    state = cut(docs.select("ord", F.lit(1).cast("long").alias("grp")))
    total = state.count()
    nodes = {1: Node(1, total)}
    trail = state  # the deepest known cluster of every document
    least = limit if limit is not None and limit > 0 else 0.0
    deeper = itertools.count(-2, -1)

    def replay() -> tuple[list[int], bool]:
        """Leaves of the search so far, and whether an unsplit cluster stopped it."""
        heap = [(-(nodes[1].gain or 0.0), 1)]
        while n is None or len(heap) < n:
            top = -heap[0][0]
            node = nodes[heap[0][1]]
            if node.gain is None:
                return [p for _, p in heap], True
            if not node.children or top <= EPSILON or top < least:
                break
            if any(nodes[c].gain is None for c in node.children):
                return [p for _, p in heap], True
            heapq.heappop(heap)
            LOG.debug("clusters %d, split %d of %d documents into %s, gain %.6f", len(heap) + 1, node.path, node.size, [nodes[c].size for c in node.children], top)
            for c in node.children:
                heapq.heappush(heap, (-nodes[c].gain, c))
        return [p for _, p in heap], False

    leaves, blocked = ([1], False) if (n is not None and n <= 1) or total == 0 else replay()
    while blocked:
        todo = [p for p, x in nodes.items() if x.gain is None and (x.parent is None or nodes[x.parent].gain >= least)]
        for p in todo:
            if nodes[p].size < 2:
                nodes[p].gain = 0.0
        todo = [p for p in todo if nodes[p].size >= 2]
        if packed and (numbered := [p for p in todo if 0 < p < DEEPEST]):
            # where a cluster fits a task, all of the search below it is done there, in one job for all such clusters
            spark = docs.sparkSession
            at = lambda paths: trail.join(F.broadcast(spark.createDataFrame([(p,) for p in paths], "grp long")), "grp").select("ord", "grp")  # noqa: B023, E731
            members = small(at(numbered))
            counted = packed.rows.select("ord", (F.length("codes") / 4).cast("long").alias("n")).join(members, "ord").groupBy("grp").agg(F.sum("n").alias("n"), (F.count("n") * packed.width).alias("all"))
            loads = {r["grp"]: (r["n"], r["all"]) for r in counted.collect()}  # a row per cluster
            room = {p: own <= most_cells(2) or full <= min(2 * own, LOCAL_BYTES // DENSE_BYTES) for p, (own, full) in loads.items()}
            if fits := [p for p in numbered if room[p]]:
                below = members if len(fits) == len(numbered) else small(at(fits))
                shared = SHARED_CELLS
                tree = lambda rows: tree_group(rows, n, limit, seed, passes, shared)  # noqa: B023, E731
                slots, parts = shared_out(spark, {p: loads[p][0] for p in fits}, spark.sparkContext.defaultParallelism * 2)
                dealt = packed.rows.join(below, "ord").join(F.broadcast(slots), "grp").repartition(parts, "slot")
                found = cut(dealt.groupBy("slot", "grp").applyInArrow(tree, "ord long, path long, gain double, size0 long, size1 long"))
                for r in sorted(found.filter("ord IS NULL").collect(), key=lambda r: r["path"]):  # a row per split
                    nodes[r["path"]].gain, nodes[r["path"]].children = r["gain"], [2 * r["path"], 2 * r["path"] + 1]
                    for c, size in zip(nodes[r["path"]].children, (r["size0"], r["size1"]), strict=True):
                        nodes[c] = Node(c, size, r["path"], None if size >= 2 else 0.0)
                deepest = found.filter("ord IS NOT NULL").select("ord", F.col("path").alias("next"))
                trail = cut(trail.join(deepest, "ord", "left").select("ord", F.coalesce("next", "grp").alias("grp")))
            for p in (p for p in numbered if not room[p]):
                ords = np.sort(trail.filter(F.col("grp") == p).select("ord").toArrow()["ord"].to_numpy())
                child, nodes[p].gain = split_packed(packed, ords, p, seed, passes)
                nodes[p].children = [2 * p, 2 * p + 1]
                for c in (0, 1):
                    nodes[2 * p + c] = Node(2 * p + c, int((child == c).sum()), p)
                trail = cut(moved_down(trail, p, ords, child))
            todo = [p for p in todo if nodes[p].gain is None]
        if todo:
            u = cut(packed.u) if u is None else u
            wanted = small(docs.sparkSession.createDataFrame([(p,) for p in todo], "grp long"))
            halves = split_groups(u, cut(trail.join(wanted, "grp").select("ord", "grp")), seed, passes)
            comp = cut(wide_composite(u, halves, 2))
            squares = comp.groupBy("grp").agg(*[F.sqrt(F.sum(c * c)).alias(a) for a, c in (("whole", F.col("s0") + F.col("s1")), ("a", F.col("s0")), ("b", F.col("s1")))])
            gains = {r["grp"]: r["a"] + r["b"] - r["whole"] for r in squares.collect()}
            sizes = {(r["grp"], r["child"]): r["count"] for r in halves.groupBy("grp", "child").count().collect()}
            for p in todo:
                nodes[p].gain = round(gains.get(p, 0.0), 12)
                for c in (0, 1):
                    path = 2 * p + c if 0 < p < DEEPEST else next(deeper)
                    nodes[p].children.append(path)
                    nodes[path] = Node(path, sizes.get((p, c), 0), p)
            paths = docs.sparkSession.createDataFrame([(p, c, path) for p in todo for c, path in enumerate(nodes[p].children)], "grp long, child int, next long")
            down = halves.join(small(paths), ["grp", "child"]).select("ord", "next")
            trail = cut(trail.join(down, "ord", "left").select("ord", F.coalesce("next", "grp").alias("grp")))
        leaves, blocked = replay()
    kept = sorted((p for p in leaves if nodes[p].size), key=lambda p: (nodes[p].gain or 0.0, p))
    deepest = {p for p in nodes if not nodes[p].children}

    def above(p: int) -> int:
        while p not in chosen and nodes[p].parent is not None:
            p = nodes[p].parent
        return p

    chosen = set(kept)
    rows = [(p, above(p)) for p in deepest]
    ids = {p: i for i, p in enumerate(kept, 1)}
    table = docs.sparkSession.createDataFrame([(p, ids[a]) for p, a in rows if a in ids] or [(-1, -1)], "grp long, cluster_id long")
    return trail.join(small(table), "grp").select("ord", "cluster_id")


def results(found: DataFrame) -> Iterator[Row]:
    """A cursor over the clusters: one row (cluster_id, ords) at a time by cluster_id, a partition in memory at once."""
    return found.groupBy("cluster_id").agg(F.array_sort(F.collect_list("ord")).alias("ords")).orderBy("cluster_id").toLocalIterator()


def cluster(u: DataFrame | Packed, docs: DataFrame, method: str = "rb", n: int | None = None, limit: float | None = None, seed: int = DEFAULT_SEED, passes: int = PASSES) -> DataFrame:
    """(ord, cluster_id) by method name; what the search held is released. Vectors packed already are for rb."""
    if method not in ("rb", "kmeans"):
        raise ValueError(f"unknown method: {method}")
    if method == "kmeans" and n is None:
        raise ValueError("kmeans needs the number of clusters; a gain limit applies to rb only")
    if isinstance(u, Packed):
        if method != "rb":
            raise ValueError("packed vectors are for rb")
        return cut(repeated_bisection(None, docs, n, limit, seed, passes, u))
    if method == "rb" and (n is not None or limit is not None) and (packed := pack(u, docs)):
        return cut(repeated_bisection(u, docs, n, limit, seed, passes, packed))
    if method == "kmeans":
        total = docs.count()
        if total < n or u.count() + total <= most_cells(max(n, 2)):  # read by one search in a task
            return cut(kmeans(u, docs, n, seed, passes))
        if packed := pack(u, docs, n):
            ords = np.sort(packed.rows.select("ord").toArrow()["ord"].to_numpy())
            if len(ords) == total:  # else documents are repeated
                return cut(_numbered(cut(kmeans_packed(packed, ords, n, seed, passes))))
    held = u.repartition("ord").persist()  # every pass joins it with the state on ord
    try:
        return cut(repeated_bisection(held, docs, n, limit, seed, passes) if method == "rb" else kmeans(held, docs, n, seed, passes))
    finally:
        held.unpersist()
