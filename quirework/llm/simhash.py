"""SimHash near-duplicates by a byte-position inverted index with count filtering.

A fingerprint is eight (position, byte) tokens. Two fingerprints that differ in at most `max_bits`
= 3 bits differ in at most 3 bytes and so share at least 5 of their 8 tokens: the guaranteed minimum.
Posting lists of single tokens would hold 1/256 of all fingerprints each and their pairs would grow with
the square of the corpus, so a posting here is for four positions taken jointly. The twenty position sets of
COVER meet every choice of five positions out of eight (a Turan system), hence a pair with the
minimum shares a posting for sure. For each pair that a posting proposes, the shared positional bytes
are tallied (zero bytes of the exclusive or); pairs below the minimum go, the rest are verified by their bits. A pair is
taken only in the first of the postings that it shares, so no distinct() follows.

Equal fingerprints are one entry of the index, so copies never become pairs. Components are found by
contraction: each round hooks every entry to its smallest neighbour, shortens the pointers and relabels the links,
until none is left; each round is a written table in the shared folder.

Results for odd input: null text counts as empty; texts without words have fingerprint 0 and link to each
other; a text of one or two words is one shingle; ties of a bit (exactly half) give 0; rows with a null id take the component
of the ids they link to, null if there is none; repeated rows each give their row; extra columns are ignored; an empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirework.llm.common import unused, written

SEED = 42
#: Shingles hashed at once; bounds memory for a very long text.
CHUNK = 1 << 18
#: Rounds of contraction; each at least halves the entries that have links.
ROUNDS = 64


def _covering() -> list[tuple[int, ...]]:
    """Twenty 4-sets of the 8 byte positions that meet every 5-set. Turan's construction for (8, 5, 4):
    three classes; a set is taken if it lies in one class, or has three of a class and one of the next, or two and two."""
    need = [set(c) for c in combinations(range(8), 5)]
    classes = ((0, 1, 2), (3, 4, 5), (6, 7))
    count = lambda s: tuple(sum(x in c for x in s) for c in classes)
    kept = []
    for s in combinations(range(8), 4):
        n = count(s)
        if max(n) == 4 or any(n[i] == 3 and n[(i + 1) % 3] == 1 or n[i] == 2 and n[(i + 1) % 3] == 2 for i in range(3)):
            kept.append(s)
    missing = [n for n in need if not any(set(s) <= n for s in kept)]
    while missing:
        best = max(combinations(range(8), 4), key=lambda s: (sum(set(s) <= n for n in missing), s))
        kept.append(best)
        missing = [n for n in missing if not set(best) <= n]
    for s in list(kept):  # a set without which all are still met is not needed
        rest = [x for x in kept if x != s]
        if all(any(set(x) <= n for x in rest) for n in need):
            kept = rest
    return kept


COVER = _covering()


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """The 64-bit fingerprint of a whole text."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) < shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    total, ones = len(words) - shingle + 1, np.zeros(64, np.int64)
    for lo in range(0, total, CHUNK):
        part = words[lo : lo + CHUNK + shingle - 1]
        n = len(part) - shingle + 1
        grams = map(b" ".join, zip(*(part[i : n + i] for i in range(shingle)), strict=True))
        h = np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(SEED)), np.uint64, n)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > total, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(id, fp) with fp the signed 64-bit form, one row for each row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = np.fromiter((fingerprint(t.as_py(), shingle) for t in b.column(1)), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(got.view(np.int64))], ["id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "id long, fp long")


def _byte(c: Column, i: int) -> Column:
    return F.shiftrightunsigned(c, 8 * i).bitwiseAND(F.lit(255))


def links(entries: DataFrame, max_bits: int = 3) -> DataFrame:
    """(a, b), a < b: pairs of distinct fingerprints `fp` of entries that differ in at most max_bits <= 3 bits."""
    if not 0 <= max_bits <= 3:
        raise ValueError("the postings guarantee pairs of at most 3 differing bits")
    keys = []
    for k, positions in enumerate(COVER):
        packed = F.lit(k).cast("long")
        for p in positions:
            packed = F.shiftleft(packed, 8).bitwiseOR(_byte(F.col("fp"), p))
        keys.append(packed)
    postings = entries.select("fp", F.explode(F.array(*keys)).alias("key"))
    left, right = postings.select("key", F.col("fp").alias("a")), postings.select("key", F.col("fp").alias("b"))
    x = F.col("a").bitwiseXOR(F.col("b"))
    same = [(_byte(x, i) == 0).cast("int") for i in range(8)]
    tally, mask = sum(same[1:], same[0]), sum((s * (1 << i) for i, s in enumerate(same[1:], 1)), same[0])
    # of the equal positions' mask: the first set of COVER within it, the posting in which the pair is taken
    first = [next((k for k, s in enumerate(COVER) if all(m >> p & 1 for p in s)), -1) for m in range(256)]
    taken = F.expr("array(" + ",".join(map(str, first)) + ")")[mask]
    return left.join(right, "key").where(
        (F.col("a") < F.col("b")) & (tally >= 8 - max_bits) & (F.bit_count(x) <= max_bits) & (F.shiftright("key", 32) == taken)
    ).select("a", "b")


def components(pairs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(node, root) for every node that has a link, by rounds of hooking, pointer jumping and contraction."""
    edges, labels = pairs, None
    for r in range(rounds):
        edges = written(edges, f"links-{r}")
        if edges.isEmpty():
            break
        both = edges.union(edges.select(F.col("b"), F.col("a"))).toDF("node", "other")
        hook = written(both.groupBy("node").agg(F.least("node", F.min("other")).alias("to")), f"hooks-{r}")
        up = hook.select(F.col("node").alias("to"), F.col("to").alias("top"))
        hook = hook.join(up, "to", "left").select("node", F.coalesce("top", "to").alias("to"))
        hook = written(hook, f"jumps-{r}")
        if labels is None:
            labels = hook.select("node", F.col("to").alias("root"))
        else:
            labels = labels.join(hook.withColumnRenamed("node", "root"), "root", "left").select("node", F.coalesce("to", "root").alias("root"))
            labels = written(labels, f"labels-{r}")
        edges = (
            edges.join(hook.toDF("a", "ta"), "a").join(hook.toDF("b", "tb"), "b")
            .select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b")).where("a < b").distinct()
        )
    else:
        raise RuntimeError(f"links are left after {rounds} rounds")
    return labels if labels is not None else pairs.sparkSession.createDataFrame([], "node long, root long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, max_bits: int = 3) -> DataFrame:
    """(id, fp, component_id): the smallest id reachable by links of at most max_bits differing bits."""
    prints = written(fingerprints(docs, id_col, text_col, shingle), "prints")
    entries = written(prints.groupBy("fp").agg(F.min("id").alias("least")), "entries")
    roots = components(links(entries, max_bits))
    linked = entries.join(roots, entries.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    linked = written(linked, "rooted")
    least = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    named = linked.join(least, "root").select("fp", "component_id")
    return prints.join(named, "fp").select("id", "fp", "component_id")


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """docs with one row of each component: that of the smallest id (of repeated rows of this id, one).
    Rows without an id can't be named as the one that stays and are all kept."""
    found = near_duplicates(docs, id_col, text_col, **how)
    own, rank = unused(docs.columns, "__stays", "__rank")
    stay = found.where("id = component_id").select(F.col("id").alias(own)).distinct()
    order = Window.partitionBy(F.col(id_col)).orderBy(F.xxhash64(text_col))
    kept = docs.join(stay, F.col(id_col) == F.col(own), "left_semi").withColumn(rank, F.row_number().over(order))
    return kept.where(F.col(rank) == 1).drop(rank).unionByName(docs.where(F.col(id_col).isNull()))


def digest(docs: DataFrame) -> DataFrame:
    """The columns of the query: doc_id, fingerprint in hexadecimal, component_id."""
    return near_duplicates(docs).select(
        F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )
