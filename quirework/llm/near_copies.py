"""Near copies by SimHash: texts of which 0.8 or more of the shingles of five words are common (Jaccard, of distinct shingles).

A text is its set of shingle hashes; equal sets are one entry, so copies never become pairs. At similarity 0.8 about 15 % of a fingerprint's bits
differ, which leaves 64 bits no byte that is sure to be equal. So a fingerprint here has 23 words: 168 byte positions are indexed, the other 90
bits are a check. Two entries of similarity 0.8 share 45 of the 168 (position, byte) tokens on average, unrelated ones less than one.
As in `simhash`, lists of single tokens would be too long, and postings are for positions taken jointly: GROUPS groups of three positions, with a posting for
each two of a group, so a pair that shares more than GROUPS tokens shares a posting for sure, and one of similarity 0.8 with probability
1 - 0.82^GROUPS (0.99998). Bits of small sets differ more often: up to SHORT shingles a second grouping is posted, up to SHORTEST a third, too.
A posting is sorted by size; each entry meets those before it of a size that allows the similarity, and is paired with the
BEFORE nearest whose check bits differ by at most RADIUS. Then the equal (position, byte) tokens of the whole fingerprints are
counted, pairs below LEAST_EQUAL go, and the sets themselves verify the rest.

Pairs are left over where an entry has more than BEFORE such neighbours, or a posting more than LIMIT entries of like size. Both entries are
marked then. Pairs within one component need no look. All marked entries of a posting in which they have several components go through an
exact search, prefix filtering: with all shingles in one order, two sets of the similarity share one of the first (1 - similarity) * n + 1 of each. The order is
rare ones first, by counts of hashed shingles, so a passage that many texts share is in no one's prefix; entries of different components that share a prefix shingle
are verified. Groups are the components of all verified pairs.

A posting holds 1/65536 of the entries or more: three at 0.5 GB, some 200 at 30 GB. Comparisons of check bits within postings therefore grow with the square of the corpus.

Odd input: null text counts as empty; texts without words are copies of each other; a text of fewer words than a shingle is one
shingle; rows without an id are no one's copies and stay; extra columns are kept; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quirework.llm.common import join_small, unused, written
from quirework.llm.simhash import CHUNK, SEED, components

SHINGLE, SIMILARITY = 5, (4, 5)
#: Words of a fingerprint: the first and the last are for the check.
WORDS, GROUPS, SHORT, SHORTEST = 23, 56, 25, 5
BEFORE, LIMIT, LEAST_EQUAL = 1, 1024, 10
#: Differing check bits of a pair at most; the second for sets of at most SHORT shingles.
RADIUS, RADIUS_SHORT = 30, 34
_DRAW = np.random.RandomState(SEED)
_ADD = _DRAW.randint(0, 1 << 62, WORDS).astype(np.uint64) * np.uint64(4) + _DRAW.randint(0, 4, WORDS).astype(np.uint64)
_ODD = np.uint64(0x9E3779B97F4A7C15)
_MIX = ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB))
#: Hashes whose bits are counted at once in bytes, entries posted at once, and hashes of sets handed on together; they bound memory.
_STEP, _POSTED, _HANDED = 255, 1 << 8, 1 << 20
#: A posting's key is followed by the size, as _SIZE_BITS bits of its logarithm to _SIZE_BASE, and by _CHECK_BITS bits of the last word.
_SIZE_BITS, _SIZE_BASE, _CHECK_BITS = 12, 1.01, 26
_SIZES_APART = int(np.ceil(np.log(SIMILARITY[1] / SIMILARITY[0]) / np.log(_SIZE_BASE))) + 1
#: Shingles are counted in 2^_ORDER_BITS buckets.
_ORDER_BITS = 18
#: Keys of postings, or ids, of at most 12 bytes a row, that are broadcast at most.
BROADCAST_ROWS = 1_000_000


def shingles(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) < shingle:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)], np.uint64)
    parts = []
    for lo in range(0, len(words) - shingle + 1, CHUNK):
        part = words[lo : lo + CHUNK + shingle - 1]
        n = len(part) - shingle + 1
        grams = map(b" ".join, zip(*(part[i : n + i] for i in range(shingle)), strict=True))
        parts.append(np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(SEED)), np.uint64, n))
    return np.unique(np.concatenate(parts))


def fingerprint(hashes: np.ndarray) -> np.ndarray:
    """The WORDS words of a set's SimHash; a bit is 1 if set in over half of its shingles' hashes, which a mixer draws out to as many words."""
    ones = np.zeros(64 * WORDS, np.int64)
    with np.errstate(over="ignore"):
        for lo in range(0, len(hashes), _STEP):
            z = hashes[lo : lo + _STEP, None] + _ADD
            for shift, factor in _MIX:
                z = (z ^ (z >> np.uint64(shift))) * np.uint64(factor)
            z ^= z >> np.uint64(31)
            bits = np.unpackbits(z.view(np.uint8), axis=1, bitorder="little")
            ones += bits.view(np.uint64).sum(axis=0).view(np.uint8)  # eight counts of a byte each at once
    return np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)


def _tables() -> list[np.ndarray]:
    """The three groupings: of each, the pairs of indexed byte positions that make a posting. No pair is in two of them."""
    i = np.arange(GROUPS)
    out = []
    for one, two in ((0, 0), (1, 3), (2, 5)):
        x, y, z = i, GROUPS + (i + one) % GROUPS, 2 * GROUPS + (i + two) % GROUPS
        out.append(np.concatenate([[x, y], [x, z], [y, z]], axis=1))
    return out


TABLES = _tables()


def postings(prints: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, keys) of the postings of fingerprints (rows of prints); keys hold the posting, the size and check bits, in that order."""
    tokens = prints[:, 1:-1].copy().view(np.uint8).astype(np.int64)
    tail = (np.log(np.maximum(sizes, 1)) / np.log(_SIZE_BASE)).astype(np.int64) << _CHECK_BITS
    tail |= (prints[:, -1] & np.uint64((1 << _CHECK_BITS) - 1)).astype(np.int64)
    for k, ((x, y), most) in enumerate(zip(TABLES, (np.inf, SHORT, SHORTEST), strict=True)):
        at = np.flatnonzero((sizes > 0) & (sizes <= most))
        table = np.arange(len(x)) + k * len(x)
        key = (table << 16) | (tokens[at][:, x] << 8) | tokens[at][:, y]
        yield np.repeat(at, len(x)), ((key << (_SIZE_BITS + _CHECK_BITS)) | tail[at, None]).reshape(-1)


def _name(hashes: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(hashes.tobytes(), SEED)


def _signed(x: list[int]) -> pa.Array:
    return pa.array(np.array(x, np.uint64).view(np.int64))


def _lists(x: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0] + [len(a) for a in x]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(x).view(np.int64) if x else np.zeros(0, np.int64)))


def _entries(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names, sizes, keys = [], [], []
            for t in b.column(1):
                s = shingles(t.as_py(), shingle)
                names.append(_name(s))
                sizes.append(len(s))
                keys.append(fingerprint(s))
            yield pa.RecordBatch.from_arrays([b.column(0), _signed(names), pa.array(sizes, pa.int64()), _lists(keys)], ["id", "name", "n", "keys"])

    return run


def _sets(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            part: list[np.ndarray] = []
            for i, t in enumerate(b.column(0)):
                part.append(shingles(t.as_py(), shingle))
                if sum(map(len, part)) >= _HANDED or i == b.num_rows - 1:
                    yield pa.RecordBatch.from_arrays([_signed([_name(s) for s in part]), _lists(part)], ["name", "items"])
                    part = []

    return run


def _words(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy().view(np.uint64).reshape(-1, WORDS)


def _posted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for lo in range(0, whole.num_rows, _POSTED):
            b = whole.slice(lo, _POSTED)
            prints, names = _words(b.column(2)), b.column(0).to_numpy()
            for at, keys in postings(prints, b.column(1).to_numpy()):
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (keys, names[at], prints[at, 0].view(np.int64))], ["key", "name", "check"])


def _meet(before: int, limit: int):
    """Over sorted postings: (a, b, false) for pairs taken, (posting, entry, true) for entries of pairs left over."""
    low = _SIZE_BITS + _CHECK_BITS
    short = int(np.log(SHORT) / np.log(_SIZE_BASE))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = [np.zeros(0, np.int64)] * 3
        for batch in batches:
            start = len(kept[0])
            key, name, check = (np.concatenate([k, batch.column(c).to_numpy()]) for c, k in enumerate(kept))
            posting, size = key >> low, (key >> _CHECK_BITS) & ((1 << _SIZE_BITS) - 1)
            extra = key & ((1 << _CHECK_BITS) - 1)
            met, marked = np.zeros(len(key), np.int32), np.zeros(len(key), bool)
            found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
            i = np.arange(start, len(key))
            for d in range(1, limit + 2):
                i = i[i >= d]
                i = i[(posting[i] == posting[i - d]) & (size[i] - size[i - d] <= _SIZES_APART)]
                if not len(i):
                    break
                if d > limit:
                    marked[i] = marked[i - d] = True
                    break
                differ = np.bitwise_count((check[i] ^ check[i - d]).view(np.uint64)).astype(np.int64) + np.bitwise_count(extra[i] ^ extra[i - d])
                near = i[(differ <= np.where(size[i] <= short, RADIUS_SHORT, RADIUS)) & (name[i] != name[i - d])]
                taken, over = near[met[near] < before], near[met[near] >= before]
                met[taken] += 1
                found.append((name[taken], name[taken - d]))
                marked[over] = marked[over - d] = True
            x, y = (np.concatenate(c) for c in zip(*found, strict=True))
            if len(x):
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y)), pa.array(np.zeros(len(x), bool))], ["a", "b", "left"])
            if marked.any():
                yield pa.RecordBatch.from_arrays([pa.array(posting[marked]), pa.array(name[marked]), pa.array(np.ones(int(marked.sum()), bool))], ["a", "b", "left"])
            kept = [c[-limit - 1 :][posting[-limit - 1 :] == posting[-1]] if len(c) else c for c in (key, name, check)]

    return run


def meetings(entries: DataFrame) -> DataFrame:
    """(a, b, left) of `_meet` over the postings of entries (name, n, keys); keys are the fingerprint's words."""
    p = entries.select("name", "n", "keys").mapInArrow(_posted, "key long, name long, check long")
    p = p.repartition(F.shiftright("key", _SIZE_BITS + _CHECK_BITS)).sortWithinPartitions("key", "name")
    return p.mapInArrow(_meet(BEFORE, LIMIT), "a long, b long, left boolean").distinct()


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        x, y = (_words(b.column(c))[:, 1:-1].copy().view(np.uint8) for c in (2, 3))
        yield b.select(["a", "b"]).filter(pa.array((x == y).sum(axis=1) >= LEAST_EQUAL))


def candidates(entries: DataFrame, met: DataFrame | None = None) -> DataFrame:
    """(a, b), a < b: pairs of entries (name, n, keys) that meet in a posting and share LEAST_EQUAL (position, byte) tokens."""
    pairs = (meetings(entries) if met is None else met).where("not left").select("a", "b")
    a, b = (entries.select(F.col("name").alias(c), F.col("keys").alias(k)) for c, k in (("a", "x"), ("b", "y")))
    return pairs.join(a, "a").join(b, "b").select("a", "b", "x", "y").mapInArrow(_count, "a long, b long")


def crowded(entries: DataFrame, met: DataFrame, roots: DataFrame) -> DataFrame:
    """(name, root, least) of the entries marked in a posting whose marked entries are of several components."""
    marks = met.where("left").select(F.col("a").alias("key"), F.col("b").alias("name"))
    rooted = written(marks.join(roots, marks.name == roots.node, "left").select("key", "name", F.coalesce("root", "name").alias("root")), "marks")
    mixed = rooted.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo != hi").select("key")
    names = rooted.join(mixed, "key", "left_semi").select("name", "root").distinct()
    return names.join(entries.select("name", "least"), "name").select("name", "root", "least")


def _bucket(items: np.ndarray) -> np.ndarray:
    return ((items.view(np.uint64) * _ODD) >> np.uint64(64 - _ORDER_BITS)).astype(np.int64)


def _frequencies(sets: DataFrame) -> np.ndarray:
    """Entries that have a shingle of each bucket; 2^_ORDER_BITS numbers, whatever the corpus."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(1 << _ORDER_BITS, np.int64)
        for b in batches:
            n += np.bincount(_bucket(b.column(0).flatten().to_numpy()), minlength=len(n))
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(n[at])], ["b", "n"])

    out = np.zeros(1 << _ORDER_BITS, np.int64)
    for r in sets.select("items").mapInArrow(run, "b int, n long").groupBy("b").agg(F.sum("n").alias("n")).collect():
        out[r.b] = r.n
    return out


def prefixes(sets: DataFrame) -> DataFrame:
    """(name, n, s, at): the prefix shingles of each set and their places in the order."""
    often, (num, den) = _frequencies(sets), SIMILARITY

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names, sizes, found, places = [], [], [], []
            for name, items in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                x = items.values.to_numpy()
                k = len(x) - -(-num * len(x) // den) + 1
                found.append(x[np.lexsort((x, often[_bucket(x)]))[:k]] if len(x) else x)
                names += [name] * len(found[-1])
                sizes += [len(x)] * len(found[-1])
                places += range(len(found[-1]))
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(sizes, pa.int64()), pa.array(np.concatenate(found) if found else np.zeros(0, np.int64)), pa.array(places, pa.int64())], ["name", "n", "s", "at"])

    return sets.select("name", "items").mapInArrow(run, "name long, n long, s long, at long")


def leftover(crowd: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b), a < b: pairs of crowded entries of different components that share a prefix shingle, if what follows it in both allows the
    similarity: the first shingle that a pair shares bounds all it can share. Of those that have a shingle, the largest component meets only the entries outside it."""
    num, den = SIMILARITY
    p = written(prefixes(sets).join(crowd.select("name", "root"), "name"), "prefixes")
    size = p.groupBy("s", "root").agg(F.count("*").alias("k"))
    mixed = size.groupBy("s").agg(F.max_by("root", F.struct("k", "root")).alias("top"), F.count("*").alias("roots")).where("roots > 1").select("s", "top")
    inside = written(p.join(mixed, "s"), "inside")
    out = inside.where("root != top").select("s", F.struct("name", "n", "at", "root").alias("e"))
    other = inside.select("s", F.struct("name", "n", "at", "root").alias("o"), (F.col("root") == F.col("top")).alias("in_top"))
    most = F.least(F.col("e.n") - F.col("e.at"), F.col("o.n") - F.col("o.at"))
    pairs = out.join(other, "s").where(
        (F.col("e.root") != F.col("o.root")) & (F.col("in_top") | (F.col("e.name") < F.col("o.name"))) & (most * (num + den) >= (F.col("e.n") + F.col("o.n")) * num)
    )
    return pairs.select(F.least("e.name", "o.name").alias("a"), F.greatest("e.name", "o.name").alias("b")).distinct()


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs whose sets (name, items) have at least the similarity, by whole numbers."""
    num, den = SIMILARITY
    a, b = sets.toDF("a", "x"), sets.toDF("b", "y")
    common = F.size(F.array_intersect("x", "y"))
    return pairs.join(a, "a").join(b, "b").where(common * (num + den) >= (F.size("x") + F.size("y")) * num).select("a", "b")


def _sets_of(texts: DataFrame, named: DataFrame, shingle: int) -> DataFrame:
    """(name, items) of the entries named (name, least); only their texts are read into sets."""
    ids = written(named.select(F.col("least").alias("id")).distinct(), "ids")
    chosen = join_small(texts, ids, "id", "left_semi", ids.count(), BROADCAST_ROWS)
    sets = chosen.select("text").mapInArrow(_sets(shingle), "name long, items array<long>")
    return written(sets.join(named.select("name"), "name", "left_semi").dropDuplicates(["name"]), "sets")


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """docs with one row of each group of near copies: that of the smallest id (of repeated rows of this id, one)."""
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("id is not null")
    prints = texts.mapInArrow(_entries(shingle), "id long, name long, n long, keys array<long>")
    entries = written(prints.groupBy("name").agg(F.min("id").alias("least"), F.first("n").alias("n"), F.first("keys").alias("keys")), "entries")
    met = written(meetings(entries), "met")
    pairs = written(candidates(entries, met), "candidates")
    used = pairs.select(F.col("a").alias("name")).union(pairs.select("b")).distinct()
    sets = _sets_of(texts, written(entries.join(used, "name", "left_semi").select("name", "least"), "used"), shingle)
    links = written(verified(pairs, sets), "links")
    roots = written(components(links), "roots")
    crowd = written(crowded(entries, met, roots), "crowded")
    if not crowd.isEmpty():
        sets = _sets_of(texts, crowd, shingle)
        roots = components(links.union(verified(written(leftover(crowd, sets), "leftover"), sets)))
    groups = entries.join(roots, entries.name == roots.node, "left").groupBy(F.coalesce("root", "name").alias("root")).agg(F.min("least").alias("least"))
    own, rank = unused(docs.columns, "__stays", "__rank")
    stay = groups.select(F.col("least").alias(own)).distinct()
    order = Window.partitionBy(F.col(id_col)).orderBy(F.xxhash64(text_col))
    kept = docs.join(stay, F.col(id_col) == F.col(own), "left_semi").withColumn(rank, F.row_number().over(order))
    return kept.where(F.col(rank) == 1).drop(rank).unionByName(docs.where(F.col(id_col).isNull()))
