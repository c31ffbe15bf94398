"""Vector code compression by filtering Lloyd: codebooks of a vector's parts, trained over kd-trees.

Vectors are cut into equal consecutive parts. Every partition packs its vectors into chunks and builds one kd-tree over each
part position of a chunk; a tree's nodes hold their bounding box and the sum of their points, their counts follow from the halving.
Trees are built once and written. In a round of Lloyd's algorithm a tree is walked from its root with all entries as candidates:
in a node, the candidate nearest to the middle of the box is compared with each other one at the corner of the box that favours the other
most; if even there the other is no nearer, no point of the box is, and it is out. Where one candidate is left, the whole subtree is its own: the cached
sum and count are added. Leaves with several candidates are settled by distances to those that are left. A partition sends only one sum and one count
for each entry, so a round moves parts x entries x components numbers for each partition; the driver gets as many once.

All arithmetic is in integers (components are floor(scale * x)), so results don't depend on how rows are dealt, and ties are exact: equal distances go to
the lower entry, in boxes too.

Results for odd input: a vector that is null, empty, or holds null, NaN or infinite components takes no part; so does one with a component too large
for exact 64-bit distances (`limit`; about 23,000 for 64 components at a scale of 4096), and one whose length isn't the table's most frequent one (of equally frequent ones the longest).
If the length doesn't divide by the parts, zeros are added at the end for training only. Rows with a null id come last in the order in which the first entries are
chosen; rows of one id by their vector. Repeated rows each give their row. With fewer rows than entries there are as many entries as rows. An empty
table, or one without a row that takes part, gives an empty result. Extra columns are ignored unless they are carried.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quirework.llm.common import floors, join_small, usual_length, written

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Points of a leaf, at least; components of a chunk, about (a chunk is one row of the table of trees).
LEAF, CHUNK = 8, 1 << 19
#: Groups of carried values up to which their sums are broadcast.
GROUPS = 100_000


class Tree(NamedTuple):
    """order: the chunk's rows in the order of the tree; points: their components in this order; boxes and sums of each level, root first."""

    order: np.ndarray
    points: np.ndarray
    low: list[np.ndarray]
    high: list[np.ndarray]
    sums: list[np.ndarray]


def _depth(n: int) -> int:
    return max(n // LEAF, 1).bit_length() - 1


def _bounds(n: int, level: int) -> np.ndarray:
    """Node i of a level holds the points from bounds[i] up to bounds[i + 1]; its children halve it."""
    return (np.arange((1 << level) + 1, dtype=np.int64) * n) >> level


def build(points: np.ndarray) -> Tree:
    """The kd-tree of a chunk's parts (n x w): every node is halved at the median of its widest side."""
    n, depth = len(points), _depth(len(points))
    order = np.arange(n, dtype=np.int32)
    for level in range(depth):
        bounds, held = _bounds(n, level), points[order]
        side = np.maximum.reduceat(held, bounds[:-1]).astype(np.int64) - np.minimum.reduceat(held, bounds[:-1])
        node = np.repeat(np.arange(1 << level), np.diff(bounds))
        order = order[np.lexsort((held[np.arange(n), side.argmax(axis=1)[node]], node))]
    held, first = points[order], _bounds(n, depth)[:-1]
    low, high, sums = [np.minimum.reduceat(held, first)], [np.maximum.reduceat(held, first)], [np.add.reduceat(held.astype(np.int64), first)]
    for _ in range(depth):
        for levels, join in ((low, np.minimum), (high, np.maximum), (sums, np.add)):
            levels.insert(0, join(levels[0][::2], levels[0][1::2]))
    return Tree(order, held, low, high, sums)


def pack(tree: Tree) -> bytes:
    return b"".join(x.tobytes() for x in (tree.order, tree.points, *tree.low, *tree.high, *tree.sums))


def unpack(data: memoryview | bytes, n: int, width: int) -> Tree:
    depth, at = _depth(n), 0

    def take(rows: int, kind: type, w: int = width) -> np.ndarray:
        nonlocal at
        got = np.frombuffer(data, kind, rows * w, at)
        at += got.nbytes
        return got.reshape(rows, w) if w == width else got

    order, points = np.frombuffer(data, np.int32, n), None
    at = order.nbytes
    points = take(n, np.int32)
    low, high, sums = ([take(1 << level, kind) for level in range(depth + 1)] for kind in (np.int32, np.int32, np.int64))
    return Tree(order, points, low, high, sums)


def settle(tree: Tree, book: np.ndarray, whole: Callable, single: Callable) -> None:
    """Give every point to the nearest entry of book: whole(level, nodes, entries) takes subtrees, single(places, entries, distances) points of leaves."""
    k, last = len(book), len(tree.low) - 1
    nodes, alive = np.zeros(1, np.int64), np.ones((1, k), bool)
    for level in range(last + 1):
        low, high = tree.low[level][nodes].astype(np.int64), tree.high[level][nodes].astype(np.int64)
        far = ((2 * book - (low + high)[:, None]) ** 2).sum(axis=2)
        far[~alive] = np.iinfo(np.int64).max
        best = far.argmin(axis=1)
        own = book[best][:, None]
        corner = np.where(book > own, high[:, None], low[:, None])
        theirs, ours = ((book - corner) ** 2).sum(axis=2), ((own - corner) ** 2).sum(axis=2)
        alive &= (theirs < ours) | ((theirs == ours) & (np.arange(k) <= best[:, None]))
        one = alive.sum(axis=1) == 1
        if one.any():
            whole(level, nodes[one], best[one])
            nodes, alive = nodes[~one], alive[~one]
        if not len(nodes):
            return
        if level < last:
            nodes, alive = np.stack((2 * nodes, 2 * nodes + 1), axis=1).reshape(-1), np.repeat(alive, 2, axis=0)
    bounds = _bounds(len(tree.points), last)
    sizes = bounds[nodes + 1] - bounds[nodes]
    places = np.repeat(bounds[nodes] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
    alive, held = np.repeat(alive, sizes, axis=0), tree.points[places].astype(np.int64)
    entry, nearest = np.zeros(len(places), np.int64), np.full(len(places), np.iinfo(np.int64).max)
    for e in range(k):
        rows = np.flatnonzero(alive[:, e])
        distance = ((held[rows] - book[e]) ** 2).sum(axis=1)
        closer = distance < nearest[rows]
        nearest[rows[closer]], entry[rows[closer]] = distance[closer], e
    single(places, entry, nearest)


def add_up(tree: Tree, book: np.ndarray, sums: np.ndarray, counts: np.ndarray) -> None:
    """Add the sums and counts of the tree's points by entry."""
    n = len(tree.points)

    def whole(level: int, nodes: np.ndarray, entries: np.ndarray) -> None:
        bounds = _bounds(n, level)
        np.add.at(sums, entries, tree.sums[level][nodes])
        np.add.at(counts, entries, bounds[nodes + 1] - bounds[nodes])

    def single(places: np.ndarray, entries: np.ndarray, _: np.ndarray) -> None:
        np.add.at(sums, entries, tree.points[places].astype(np.int64))
        np.add.at(counts, entries, 1)

    settle(tree, book, whole, single)


def assign(tree: Tree, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(entry, squared distance) of every row of the chunk."""
    n = len(tree.points)
    entry, distance = np.zeros(n, np.int64), np.zeros(n, np.int64)

    def whole(level: int, nodes: np.ndarray, entries: np.ndarray) -> None:
        bounds = _bounds(n, level)
        for lo, hi, e in zip(bounds[nodes], bounds[nodes + 1], entries, strict=True):
            entry[lo:hi] = e
            distance[lo:hi] = ((tree.points[lo:hi].astype(np.int64) - book[e]) ** 2).sum(axis=1)

    def single(places: np.ndarray, entries: np.ndarray, distances: np.ndarray) -> None:
        entry[places], distance[places] = entries, distances

    settle(tree, book, whole, single)
    back = np.empty(n, np.int64)
    back[tree.order] = np.arange(n)
    return entry[back], distance[back]


def limit(width: int) -> int:
    """The largest component, scaled, for which all squared distances of whole vectors (and four times those) fit a long."""
    return math.isqrt(((1 << 63) - 1) // (16 * max(width, 1)))


def _first_rows(ids: pa.Array, ints: np.ndarray, count: int) -> np.ndarray:
    """The rows of the `count` smallest ids, null ids last, rows of one id by their components."""
    none = np.asarray(ids.is_null())
    key = ids.fill_null(np.iinfo(np.int64).max).to_numpy()
    rows = np.arange(len(key))
    if len(key) > count:
        rows = np.flatnonzero(key <= np.partition(key, count - 1)[count - 1])
    return rows[np.lexsort((*ints[rows].T[::-1], key[rows], none[rows]))[:count]]


def _chunks(batches: Iterator[pa.RecordBatch], length: int, parts: int, entries: int, scale: float) -> Iterator[pa.RecordBatch]:
    """Columns (row: struct of id and carried columns, vec): chunks of rows with a tree for each part, and the first rows' components."""
    padded = -(-length // parts) * parts
    for b in batches:
        kept, ints = floors(b.column(1), length, scale, limit(padded))
        rows = b.column(0).filter(kept)
        ints = np.pad(ints.astype(np.int32), ((0, 0), (0, padded - length)))
        for lo in range(0, len(ints), step := max(LEAF, CHUNK // padded)):
            x, own = ints[lo : lo + step], rows.slice(lo, step)
            trees = [pack(build(p)) for p in np.split(x, parts, axis=1)]
            first = _first_rows(own.field(0), x, entries)
            starts = [{"id": i, "ints": v.tolist()} for i, v in zip(own.field(0).take(pa.array(first)).to_pylist(), x[first], strict=True)]
            listed = pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.concat_arrays([own]))
            kind = pa.list_(pa.struct([("id", pa.int64()), ("ints", pa.list_(pa.int32()))]))
            yield pa.RecordBatch.from_arrays([listed, pa.array([trees], pa.list_(pa.binary())), pa.array([starts], kind)], ["rows", "trees", "starts"])


def _trees(b: pa.RecordBatch, width: int) -> Iterator[tuple[pa.Array, list[Tree]]]:
    rows, trees = b.column("rows"), b.column("trees")
    for i in range(b.num_rows):
        own = rows[i].values
        yield own, [unpack(t.as_buffer(), len(own), width) for t in trees[i].values]


class Codebooks(NamedTuple):
    """books: parts x entries x width integers; length: components of a vector; scale: of the integers."""

    books: np.ndarray
    length: int
    scale: float

    def sha256(self) -> str:
        parts, entries, width = self.books.shape
        real = self.books.transpose(1, 0, 2).reshape(entries, parts * width)[:, : self.length]  # without added zeros
        cut = [real[e, p * width : (p + 1) * width] for p in range(parts) for e in range(entries)]
        return hashlib.sha256(",".join(str(x) for c in cut for x in c.tolist()).encode()).hexdigest()


def compress(
    vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", carry: tuple[str, ...] = (),
    parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: float = SCALE,
) -> tuple[DataFrame, Codebooks | None]:
    """((row: struct of id and the carried columns, code, error), codebooks). code: an entry's index in two hexadecimal digits for each part;
    error: the squared distances to these entries, summed over parts, in scaled units. Codebooks are None if no row takes part."""
    if not 0 < entries <= 256:
        raise ValueError("a code has two hexadecimal digits for each part")
    spark, length = vectors.sparkSession, usual_length(vectors, vec_col)
    row = F.struct(F.col(id_col).cast("long").alias("id"), *[F.col(c).alias(f"carried_{i}") for i, c in enumerate(carry)])
    d = vectors.select(row.alias("row"), F.col(vec_col).alias("vec"))
    kind = T.StructType([d.schema["row"], T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])
    if not length:
        return spark.createDataFrame([], kind), None
    width = -(-length // parts)
    chunk = T.StructType([
        T.StructField("rows", T.ArrayType(d.schema["row"].dataType)), T.StructField("trees", T.ArrayType(T.BinaryType())),
        T.StructField("starts", T.ArrayType(T.StructType([T.StructField("id", T.LongType()), T.StructField("ints", T.ArrayType(T.IntegerType()))]))),
    ])
    made = d.mapInArrow(lambda bs: _chunks(bs, length, parts, entries, scale), chunk)
    # rows are large: row groups of 16 MB, looked at every few rows, bound what readers hold
    trees = written(made, "trees", **{"parquet.block.size": 16 << 20, "parquet.page.size.row.check.min": 4, "parquet.enable.dictionary": "false"})
    first = trees.select(F.explode("starts").alias("s")).select("s.*").orderBy(F.col("id").asc_nulls_last(), "ints").limit(entries).collect()
    if not first:
        return spark.createDataFrame([], kind), None
    books = np.array([r.ints for r in first], np.int64).reshape(len(first), parts, width).transpose(1, 0, 2)
    for _ in range(rounds):
        books = _moved(trees, books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for own, found in _trees(b, width):
                got = [assign(t, book) for t, book in zip(found, books, strict=True)]
                digits = np.stack([e for e, _ in got], axis=1).astype(np.uint8)
                codes = pa.array([r.tobytes().hex() for r in digits], pa.string())
                yield pa.RecordBatch.from_arrays([pa.concat_arrays([own]), codes, pa.array(sum(e for _, e in got), pa.int64())], ["row", "code", "error"])

    return trees.select("rows", "trees").mapInArrow(run, kind), Codebooks(books, length, scale)


def _moved(trees: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks after one round: every entry at the floor of its points' mean, unused entries where they were."""
    parts, k, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros(books.shape, np.int64), np.zeros((parts, k), np.int64)
        for b in batches:
            for _, found in _trees(b, width):
                for p, tree in enumerate(found):
                    add_up(tree, books[p], sums[p], counts[p])
        p, e = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(p, pa.int32()), pa.array(e, pa.int32()), pa.array(counts[p, e]), pa.array(sums[p, e].tolist(), pa.list_(pa.int64()))], ["part", "entry", "n", "sums"])

    sent = trees.select("rows", "trees").mapInArrow(run, "part int, entry int, n long, sums array<bigint>")
    flat = sent.select("part", "entry", "n", F.posexplode("sums").alias("at", "s"))
    total = flat.groupBy("part", "entry", "at").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
    moved = books.copy()
    for r in total.collect():  # parts x entries x width rows, whatever the table
        moved[r.part, r.entry, r.at] = int(r.s) // r.n
    return moved


def decode(codes: DataFrame, books: Codebooks, code_col: str = "code", out: str = "decoded") -> DataFrame:
    """codes with the vectors that their codes stand for, as array<double>; null for a null code."""

    @F.pandas_udf("array<double>")
    def run(code):
        at = np.arange(len(books.books))
        back = lambda c: (books.books[at, np.frombuffer(bytes.fromhex(c), np.uint8)].reshape(-1)[: books.length] / books.scale).tolist()
        return code.map(lambda c: None if c is None else back(c))

    return codes.withColumn(out, run(F.col(code_col)))


def digest(vectors: DataFrame) -> DataFrame:
    """The columns of the query: vec_id, code, error, label_error (null if the sum doesn't fit a long), codebooks_sha256."""
    done, books = compress(vectors, carry=("label",))
    rows = written(done.select(F.col("row.id").alias("vec_id"), F.col("row.carried_0").alias("label"), "code", "error"), "codes")
    by_label = rows.groupBy("label").agg(F.try_sum("error").alias("label_error")).withColumnRenamed("label", "of")
    by_label = written(by_label, "label-errors")
    joined = join_small(rows, by_label, rows.label.eqNullSafe(by_label.of), "inner", by_label.count(), GROUPS)
    return joined.select("vec_id", "code", "error", "label_error", F.lit(books.sha256() if books else None).cast("string").alias("codebooks_sha256"))
