"""Periodic runs of words, found by bit-parallel lags.

A text's words become ids, and the ids' bits become planes: big integers of one bit a word. For a lag q each plane is XORed with itself
shifted by q and the differences are ORed; a zero of the result is a word equal to the one q places later. A run of period q and of
length n is a stretch of n - q zeros, so a stretch must have `need` = max(shortest, times * q) - q of them: shift-doubling AND over the
complement (R &= R >> 1, then >> 2, >> 4 ...) leaves one bit for each start of `need` zeros, in about log2(need) steps. Most lags are
empty after the first planes and few doublings, when the rest is left out.

Lags up to n / times are all tried. A lag that is a multiple of a run's period finds the same stretch again; of equal stretches the
smallest lag stays, which is the period. (A stretch of three or more periods q that also has a smaller period p has one that divides q,
and then neither can be extended without the other, so the stretches are equal.)

A text of more than LONG words costs lags in proportion to its square, so it isn't left to one task: its lags are dealt out in pieces,
each of about the work of a text of LONG words, and the pieces' stretches are merged by text.

Results for odd input: null, empty and blank texts have no words and no run; rows with a null id are processed like all others;
repeated rows each give their row; extra columns are ignored; an empty table gives an empty result. Of stretches with the same
exact exponent the one with the smallest start, then period, is the row's greatest run.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirework.llm.common import SPACE_RUN, unused, written

#: A run has this many words, and this many periods, at least.
SHORTEST, TIMES = 24, 3
#: Planes looked at before the first doubling.
FIRST_PLANES = 2
#: Words of a text whose lags one task takes.
LONG = 65_536

RUN = "struct<start:bigint,length:bigint,period:bigint>"


def planes(ids: np.ndarray) -> list[int]:
    """The bits of the ids as big integers, bit i of plane b being bit b of ids[i]."""
    top = int(ids.max()).bit_length() if len(ids) else 0
    return [int.from_bytes(np.packbits((ids >> b & 1).astype(np.uint8), bitorder="little").tobytes(), "little") for b in range(max(top, 1))]


def _starts(equal: int, need: int) -> int:
    """The places from which on `need` bits are set."""
    have = 1
    while have < need and equal:
        step = min(have, need - have)
        equal &= equal >> step
        have += step
    return equal


def _stretches(bits: int) -> Iterator[tuple[int, int]]:
    """(first, length) of the stretches of set bits."""
    at = 0
    while bits:
        skip = (bits & -bits).bit_length() - 1
        bits >>= skip
        n = (~bits & (bits + 1)).bit_length() - 1
        yield at + skip, n
        bits >>= n
        at += skip + n


def stretches(ids: np.ndarray, lags: Iterable[int], shortest: int = SHORTEST, times: int = TIMES) -> Iterator[tuple[int, int, int]]:
    """(start, length, lag): what repeats itself at one of the lags and is long enough for it."""
    n, bits = len(ids), planes(ids)
    first, rest = bits[:FIRST_PLANES], bits[FIRST_PLANES:]
    for q in lags:
        need, inside = max(shortest, times * q) - q, (1 << (n - q)) - 1
        if need > n - q:
            continue
        differ = 0
        for p in first:
            differ |= p ^ (p >> q)
        if not (found := _starts(~differ & inside, need)):
            continue
        if rest:
            for p in rest:
                differ |= p ^ (p >> q)
            found = _starts(~differ & inside, need)
        for start, more in _stretches(found):
            yield start, more - 1 + need + q, q


def smallest_periods(found: Iterable[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Of equal stretches the one of the smallest lag, by start and period."""
    least: dict[tuple[int, int], int] = {}
    for start, length, q in found:
        least[start, length] = min(q, least.get((start, length), q))
    return sorted(((s, n, q) for (s, n), q in least.items()), key=lambda r: (r[0], r[2]))


def word_ids(words: list[bytes]) -> np.ndarray:
    seen: dict[bytes, int] = {}
    return np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))


def runs(words: list[bytes], shortest: int = SHORTEST, times: int = TIMES) -> list[tuple[int, int, int]]:
    """All (start, length, period) of a text's words."""
    return smallest_periods(stretches(word_ids(words), range(1, len(words) // times + 1), shortest, times)) if len(words) >= shortest else []


def split(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split()


def tiled(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """The words of the query's contract: one document in ten by crc32 of its id repeats p of its words from place a on."""
    if doc_id is None or not words:
        return words
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + i % p] for i in range(n - a)]


def collapsed(words: list[bytes], found: list[tuple[int, int, int]]) -> bytes:
    """The words that are left when every run keeps its first period only."""
    keep = np.ones(len(words), bool)
    for start, length, q in found:
        keep[start + q : start + length] = False
    return b" ".join(compress(words, keep))


def _words(text: str | None, doc_id: int | None, tile: bool) -> list[bytes]:
    return tiled(split(text), doc_id) if tile else split(text)


def _whole(batches: Iterator[pa.RecordBatch], shortest: int, times: int, tile: bool) -> Iterator[pa.RecordBatch]:
    """Columns (id, text, found or null): found are a long text's stretches by lags that other tasks took."""
    names = ["id", "runs", "collapsed"]
    kinds = [pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])), pa.string()]
    for b in batches:
        for lo in range(0, b.num_rows, 256):  # texts of a step are held once more as words and once as results
            part, out = b.slice(lo, 256), ([], [], [])
            for i, text, found in zip(*(c.to_pylist() for c in part.columns), strict=True):
                words = _words(text, i, tile)
                got = runs(words, shortest, times) if found is None else smallest_periods((f["start"], f["length"], f["period"]) for f in found)
                for to, x in zip(out, (i, [{"start": s, "length": n, "period": q} for s, n, q in got], collapsed(words, got).decode("utf-8", "surrogatepass")), strict=True):
                    to.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds, strict=True)], names)


def _piece(batches: Iterator[pa.RecordBatch], shortest: int, times: int, tile: bool) -> Iterator[pa.RecordBatch]:
    """Columns (row, id, text, piece, pieces): the stretches of every lag that is `piece` modulo `pieces`, by row."""
    for b in batches:
        for row, i, text, piece, pieces in zip(*(c for c in b.columns), strict=True):
            words = _words(text.as_py(), i.as_py(), tile)
            lags = range(1 + piece.as_py(), len(words) // times + 1, pieces.as_py())
            got = list(stretches(word_ids(words), lags, shortest, times)) if len(words) >= shortest else []
            cols = [[row.as_py()] * len(got), *([r[k] for r in got] for k in range(3))]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["row", "start", "length", "lag"])


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shortest: int = SHORTEST, times: int = TIMES, tile: bool = False, long: int = LONG) -> DataFrame:
    """(id, runs, collapsed), one row for each row of docs: runs are (start, length, period) by start and period, collapsed is the
    text of the words that are left when each run keeps its first period, joined by single spaces. tile: read `tiled` words."""
    d = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    size = _n_words(F.col("text"))
    done = "id long, runs array<" + RUN + ">, collapsed string"
    whole = lambda bs: _whole(bs, shortest, times, tile)
    none = F.lit(None).cast(f"array<{RUN}>").alias("found")
    short = d.where(F.col("text").isNull() | (F.octet_length("text") < 2 * long) | (size < long)).select("id", "text", none).mapInArrow(whole, done)
    big = d.where((F.octet_length("text") >= 2 * long) & (size >= long)).select(F.monotonically_increasing_id().alias("row"), "id", "text")
    big = written(big, "long-texts")  # the row numbers hold from here on
    if big.isEmpty():
        return short
    pieces = F.ceil((_n_words(F.col("text")) / long) ** 2).cast("int")
    dealt = big.withColumn("pieces", pieces).withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
    dealt = dealt.select("row", "id", "text", "piece", "pieces").repartition(max(2, docs.sparkSession.sparkContext.defaultParallelism), "row", "piece")
    found = dealt.mapInArrow(lambda bs: _piece(bs, shortest, times, tile), "row long, start long, length long, lag long")
    # as in smallest_periods, here over the pieces
    found = found.groupBy("row", "start", "length").agg(F.min("lag").alias("period")).groupBy("row").agg(F.collect_list(F.struct("start", "length", "period")).alias("found"))
    given = big.join(found, "row", "left").select("id", "text", F.coalesce("found", F.array().cast(f"array<{RUN}>")).alias("found"))
    return short.unionByName(given.mapInArrow(whole, done))


def _n_words(c: Column) -> Column:
    return F.size(F.array_remove(F.split(c, SPACE_RUN), ""))


def collapse(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """docs with every text collapsed in which a run was found; other texts, ids and columns stay as they are. Needs ids that aren't repeated."""
    own, text = unused(docs.columns, "__id", "__text")
    found = find(docs, id_col, text_col, **how).where(F.size("runs") > 0).select(F.col("id").alias(own), F.col("collapsed").alias(text))
    joined = docs.join(found, F.col(id_col) == F.col(own), "left")
    return joined.select(*[F.coalesce(text, c).alias(c) if c == text_col else F.col(c) for c in docs.columns])


def digest(docs: DataFrame) -> DataFrame:
    """The columns of the query, over the words that its contract tiles."""
    more = "r.length * best.period > best.length * r.period"  # runs come by start and period, so the first of equals stays
    best = F.expr(f"aggregate(runs, runs[0], (best, r) -> CASE WHEN {more} THEN r ELSE best END)")
    listed = F.expr("concat_ws('', transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\\n')))")
    found = find(docs, tile=True).withColumn("best", F.when(F.size("runs") > 0, best))
    return found.select(
        F.col("id").alias("doc_id"), F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"), F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
