"""Benchmark decontamination by q-gram lemma filtering.

Texts are folded to letters and digits in lower case with one space between runs of others. An item of m folded characters may
occur with up to k = floor(rate * m) edits; then, by the q-gram lemma, item and occurrence share at least T = m + 1 - q(k + 1)
q-grams, all on diagonals (text position less item position) at most k apart. Hits are tallied in diagonal bands of
width 2w that overlap by w >= k (w by item), so some band holds all shared q-grams; bands with T hits or more are kept and verified
by banded alignment, which gives edits, start and end of every best diagonal of a band; where an item stands exactly, its exact occurrences are
taken one behind the other from the left, and the rest of the text is aligned. If T would be less than 1, k is lowered until it is 1
(short items), never T; items of fewer than q characters must occur as whole words exactly.

Documents are not shuffled: each task folds its rows in blocks of about BLOCK characters; a longer text is folded piece by piece, each
searched together with the last folded characters of those before it, enough for two of the longest occurrence, however many characters were
dropped between them. So a text of any length is searched whole in bounded memory. The
items are the stated query set: their index goes to the tasks if it has at most ITEM_CHARS characters, else the items are dealt into
blocks of that size by hash of their id, with one written pass over the documents for each, so that the driver and the tasks hold one
block at a time; no item is left out. Hits of a repetitive item in a repetitive text grow with the product of both; they are expanded EXPAND at a time
and kept as tallies of bands.

Odd input: null or empty texts and items match nothing; repeated items or ids each give their rows; a repeated row gives its own spans;
overlapping occurrences of one item are one span, that of fewest edits (ties: the first); extra columns are kept; without
items all documents stay.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirework.llm.common import unused, written

Q, RATE = 8, 0.1
BLOCK = 1 << 20
ITEM_CHARS = 4_000_000
#: Hits held at once.
EXPAND = 1 << 21
SPAN = pa.struct([("item_id", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("edits", pa.int32())])
SPANS_DDL = "array<struct<item_id: long, start: long, end: long, edits: int>>"
_BITS = 20
_MIX = np.uint64(0x9E3779B97F4A7C15)
_FOLD: list[np.ndarray] = []


def _fold_table() -> np.ndarray:
    if not _FOLD:
        low = [(c.lower() if c.isalnum() else " ") for c in map(chr, range(0x10000))]
        _FOLD.append(np.array([ord(c) if len(c) == 1 else ord(c[0]) for c in low], np.uint32))
        _FOLD[0][0] = 0
    return _FOLD[0]


def fold(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Folded code points of text and the offset of each; code 0 (a block's divider) stays."""
    raw = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    codes = _fold_table()[np.minimum(raw, 0xFFFF)]
    if len(raw) and raw.max() > 0xFFFF:
        high = np.flatnonzero(raw > 0xFFFF)
        found, which = np.unique(raw[high], return_inverse=True)
        codes[high] = np.array([ord(c.lower()[0]) if c.isalnum() else 32 for c in map(chr, found.tolist())], np.uint32)[which]
    gap = codes == 32
    keep = ~gap
    keep[1:] |= ~gap[:-1] & (codes[:-1] != 0)  # a text's first blank goes, wherever in a block it begins
    at = np.flatnonzero(keep)
    return codes[at], at


def _grams(codes: np.ndarray, q: int) -> np.ndarray:
    """A 64-bit hash of each q-gram; q is a power of two."""
    h, step, factor = codes.astype(np.uint64), 1, _MIX
    with np.errstate(over="ignore"):
        while step < q:
            h = h[:-step] * factor + h[step:]
            factor, step = factor * factor, 2 * step
        h *= _MIX
    return h ^ (h >> np.uint64(29))


#: In a cell of the alignment, edits stand above the place where the stretch starts, counted down from here: of equal edits the latest start is less.
_EDIT, _PLACE = np.int64(1) << np.int64(40), np.int64((1 << 40) - 1)


def align(item: np.ndarray, text: np.ndarray, lo: int, hi: int, budget: int) -> tuple[int, list[tuple[int, int]]] | None:
    """Fewest edits between the whole item and a stretch of text that ends on diagonals lo..hi, and the (start, end) of stretches of so many, one for each end; None beyond the budget."""
    width, far = hi - lo + 1, (np.int64(1) << np.int64(20)) * _EDIT
    ramp, m = np.arange(width, dtype=np.int64), len(item)
    before = max(0, -lo)
    padded = np.zeros(before + len(text) + max(0, m + hi + 1 - len(text)) + 1, np.uint32)
    padded[before : before + len(text)] = text
    j = ramp + lo
    row = np.where((j < 0) | (j > len(text)), far, _PLACE - j)
    steps = ramp * _EDIT
    for i in range(m):
        at = before + i + lo
        best = row + np.where(padded[at : at + width] != item[i], _EDIT, 0)
        if i + lo < 0:
            best[: -(i + lo)] = far
        np.minimum(best[:-1], row[1:] + _EDIT, out=best[:-1])
        row = np.minimum.accumulate(best - steps) + steps
        if i + lo < -1:  # cells before the text, but for the one where all of the item so far is left out
            row[: -(i + 1 + lo)] = far
        if i + 1 + lo <= 0 <= i + 1 + hi:
            row[-(i + 1 + lo)] = min(row[-(i + 1 + lo)], (i + 1) * _EDIT + _PLACE)
        if row.min() >= (budget + 1) * _EDIT:
            return None
    row = np.where(j + m <= len(text), row, far)
    edits = row // _EDIT
    least = int(edits.min())
    return (least, [(int(_PLACE - row[x] % _EDIT), m + lo + int(x)) for x in np.flatnonzero(edits == least)]) if least <= budget else None


class Items:
    """The index of a block of items."""

    def __init__(self, rows: list[tuple[int, str]], q: int = Q, rate: float = RATE):
        self.q, self.ids, self.codes, self.k, self.need, self.short = q, [], [], [], [], []
        for i, text in rows:
            c, _ = fold((text or "").replace("\0", " "))
            c = c[1:] if len(c) and c[0] == 32 else c
            c = c[:-1] if len(c) and c[-1] == 32 else c
            m = len(c)
            if not m:
                continue
            if m < q:
                self.short.append((i, c))
                continue
            k = int(rate * m)
            while k and m + 1 - q * (k + 1) < 1:
                k -= 1
            self.ids.append(i)
            self.codes.append(c)
            self.k.append(k)
            self.need.append(m + 1 - q * (k + 1))
        self.longest = max([len(c) + k for c, k in zip(self.codes, self.k, strict=True)] + [len(c) + 2 for _, c in self.short] + [0])
        # halves of bands by item: two occurrences of an item that do not overlap are never in one band
        self.shift = np.array([max(1, k).bit_length() for k in self.k], np.int64)
        if self.ids:
            n = [len(c) - q + 1 for c in self.codes]
            h = np.concatenate([_grams(c, q) for c in self.codes])
            order = np.argsort(h, kind="stable")
            self.item = np.repeat(np.arange(len(n), dtype=np.int32), n)[order]
            self.pos = np.concatenate([np.arange(x, dtype=np.int32) for x in n])[order]
            self.hash, self.first, self.count = np.unique(h[order], return_index=True, return_counts=True)
            self.table = np.zeros(1 << _BITS, bool)
            self.table[self.hash >> np.uint64(64 - _BITS)] = True
            self.need_of = np.array(self.need, np.int64)

    def search(self, codes: np.ndarray) -> list[tuple[int, int, int, int]]:
        """(item id, start, end, edits) in folded codes."""
        found = []
        if self.ids and len(codes) >= self.q:
            h = _grams(codes, self.q)
            at = np.flatnonzero(self.table[h >> np.uint64(64 - _BITS)])
            k = np.searchsorted(self.hash, h[at])
            k[k == len(self.hash)] = 0
            ok = self.hash[k] == h[at]
            at, k = at[ok], k[ok]
            bands = (len(codes) + 2 * self.longest >> int(self.shift.min())) + 2
            # hits of one band count together only within one text of the block
            cuts = np.flatnonzero(codes == 0)
            key, hits = self._tallies(at, k, np.searchsorted(cuts, at), len(cuts) + 1, bands)
            nxt = np.zeros_like(hits)
            follows = np.flatnonzero(key[1:] == key[:-1] + 1)
            nxt[follows] = hits[follows + 1]
            exact: dict[tuple[int, int], list[int]] = {}
            # a band is two neighbouring halves; a half without hits before one with hits adds nothing to it alone
            for x in np.flatnonzero(hits + nxt >= self.need_of[key // (bands * (len(cuts) + 1))]):
                i, b = divmod(int(key[x]), bands)
                i, part = divmod(i, len(cuts) + 1)
                begin, stop = int(cuts[part - 1]) + 1 if part else 0, int(cuts[part]) if part < len(cuts) else len(codes)
                lo, half = (b << int(self.shift[i])) - self.longest, 1 << int(self.shift[i])
                for s, e, edits in self._verify(i, codes[begin:stop], lo - begin, lo - begin + 2 * half - 1, exact.setdefault((i, part), [])):
                    found.append((self.ids[i], s + begin, e + begin, edits))
        for i, c in self.short:
            found += [(i, s, s + len(c), 0) for s in _occurrences(codes, c)]
        return _apart(found)

    def _tallies(self, at: np.ndarray, k: np.ndarray, inside: np.ndarray, texts: int, bands: int) -> tuple[np.ndarray, np.ndarray]:
        """(key, hits) of each half band that has hits: places `at` of the text with their entries k of the table and the texts that they are in."""
        ends = np.cumsum(self.count[k])
        keys, hits, held, lo = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0, 0

        def merged() -> tuple[np.ndarray, np.ndarray]:
            key, where = np.unique(np.concatenate(keys), return_inverse=True)
            return key, np.bincount(where, np.concatenate(hits), len(key)).astype(np.int64)

        while lo < len(at):
            hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + EXPAND, "right")))
            for of in range(0, int(self.count[k[lo]]) if hi == lo + 1 else 1, EXPAND):  # one place may have more entries than that
                n = np.minimum(self.count[k[lo:hi]] - of, EXPAND)
                stop = np.cumsum(n)
                entry = np.arange(stop[-1]) + np.repeat(self.first[k[lo:hi]] + of - stop + n, n)
                item = self.item[entry]
                # positions are moved up by the longest item, so that diagonals are never negative
                band = (np.repeat(at[lo:hi], n) - self.pos[entry] + self.longest) >> self.shift[item]
                key, count = np.unique((item.astype(np.int64) * texts + np.repeat(inside[lo:hi], n)) * bands + band, return_counts=True)
                keys.append(key)
                hits.append(count)
                held += len(key)
            if held > EXPAND:
                key, count = merged()
                keys, hits, held = [key], [count], 0
            lo = hi
        return merged()

    def _verify(self, i: int, codes: np.ndarray, lo: int, hi: int, exact: list[int]) -> list[tuple[int, int, int]]:
        """(start, end, edits) of the item in a text on diagonals lo..hi. exact: starts of its exact occurrences in the text, apart, once some are known."""
        item, k = self.codes[i], self.k[i]
        m = len(item)
        a, b = max(0, lo), min(len(codes), hi + m + k + 1)
        text, out = codes[a:b], []
        if _find(text, item, 0) >= 0:
            if not exact:
                at, raw, own = 0, codes.tobytes(), item.tobytes()
                while (at := _find_in(raw, own, at)) >= 0:
                    exact.append(at)
                    at += m
                out += [(s, s + m, 0) for s in exact]
            # what else could stand here needs room between those
            first = max(0, bisect_left(exact, a - m) - 1)
            edges = [exact[first - 1] + m if first else 0]
            room, x = False, first
            while not room and edges[-1] < b:
                to = exact[x] if x < len(exact) else len(codes)
                room = to - edges[-1] >= m - k and to > a
                edges.append(to + m)
                x += 1
            if not room:
                return out
        if not (got := align(item, text, lo - a - k, hi - a + k, k)):
            return out
        return out + [(a + start, a + end, got[0]) for start, end in got[1]]


def _find_in(raw: bytes, item: bytes, at: int) -> int:
    """Where the item's code points stand in raw ones from place `at` on, or -1."""
    spot = raw.find(item, 4 * at)
    while spot >= 0 and spot % 4:
        spot = raw.find(item, spot + 1)
    return spot // 4 if spot >= 0 else -1


def _find(text: np.ndarray, item: np.ndarray, at: int) -> int:
    return _find_in(text.tobytes(), item.tobytes(), at)


def _occurrences(codes: np.ndarray, item: np.ndarray) -> list[int]:
    """Where a short item stands as whole words."""
    n, m = len(codes), len(item)
    if n < m:
        return []
    same = np.ones(n - m + 1, bool)
    for x in range(m):
        same &= codes[x : n - m + 1 + x] == item[x]
    edge = lambda p: p < 0 or p >= n or codes[p] in (0, 32)
    return [int(s) for s in np.flatnonzero(same) if edge(s - 1) and edge(s + m)]


def _apart(found: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
    """Of overlapping spans of one item, that of fewest edits, then the first."""
    kept: dict[int, list[tuple[int, int, int]]] = {}
    for item, start, end, edits in sorted(set(found), key=lambda f: (f[0], f[3], f[1], f[2])):
        own = kept.setdefault(item, [])  # these are apart, so only the neighbours can overlap
        at = bisect_left(own, (start, end, edits))
        if not (at and own[at - 1][1] > start or at < len(own) and own[at][0] < end):
            own.insert(at, (start, end, edits))
    return sorted(((i, *x) for i, own in kept.items() for x in own), key=lambda f: (f[1], f[2], f[0]))


def _pieces(text: str, items: Items, block: int) -> list[tuple[int, int, int, int]]:
    """The spans of one long text."""
    found, reach = [], 2 * items.longest + 2
    codes, at = np.zeros(0, np.uint32), np.zeros(0, np.int64)
    for lo in range(0, len(text), block):
        before = min(lo, 1)  # the character before a piece says whether its first blank stays
        c, a = fold(text[lo - before : lo + block])
        own = a >= before
        codes, at = np.concatenate([codes[-reach:], c[own]]), np.concatenate([at[-reach:], a[own] + lo - before])
        last = lo + block >= len(text)
        for item, s, e, edits in items.search(codes):
            # what touches a cut end is seen whole with the piece before or the one after
            if (s > 0 or not lo) and (e < len(codes) or last):
                found.append((item, int(at[s]), int(at[e - 1]) + 1, edits))
    return found


def find_spans(texts: list[str | None], items: Items, block: int = BLOCK) -> list[list[tuple[int, int, int, int]]]:
    """For each text the (item id, start, end, edits), offsets in code points of the text."""
    out: list[list[tuple[int, int, int, int]]] = [[] for _ in texts]
    part: list[tuple[int, str]] = []
    size = 0

    def flush() -> None:
        nonlocal size
        starts = np.cumsum([0] + [len(s) + 1 for _, s in part])
        codes, at = fold("\0".join(s for _, s in part))
        for item, a, b, edits in items.search(codes):
            s, e = int(at[a]), int(at[b - 1]) + 1
            p = int(np.searchsorted(starts, s, "right")) - 1
            out[part[p][0]].append((item, s - int(starts[p]), e - int(starts[p]), edits))
        part.clear()
        size = 0

    for t, text in enumerate(texts):
        text = (text or "").replace("\0", " ")
        if len(text) > block:
            out[t] = _pieces(text, items, block)
            continue
        part.append((t, text))
        size += len(text) + 1
        if size >= block:
            flush()
    if part:
        flush()
    return [_apart(x) if len(x) > 1 else x for x in out]


def item_blocks(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", chars: int = ITEM_CHARS) -> Iterator[list[tuple[int, str]]]:
    """The items in blocks of about `chars` characters, one at a time on the driver."""
    b = benchmark.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).alias("t")).where("t is not null")
    total = b.agg(F.sum(F.char_length("t"))).first()[0] or 0
    n = max(1, -(-total // chars))
    for x in range(n):
        yield [(r.i, r.t) for r in (b if n == 1 else b.where(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == x)).collect()]


def _finder(items: Items):
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for a in batches:
            got = find_spans(a.to_pylist(), items)
            yield pa.array([[dict(zip(("item_id", "start", "end", "edits"), s, strict=True)) for s in x] for x in got], pa.list_(SPAN))

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, SPANS_DDL)


def with_spans(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", out: str = "spans", q: int = Q, rate: float = RATE, chars: int = ITEM_CHARS) -> DataFrame:
    """docs with a column of the spans (item_id, start, end, edits) of benchmark items in the text."""
    if out in docs.columns:
        raise ValueError(f"docs has a column {out}; name another")
    done = None
    for rows in item_blocks(benchmark, chars=chars):
        here = _finder(Items(rows, q, rate))(F.col(f"`{text_col}`"))
        done = docs.withColumn(out, here) if done is None else written(done, "spans").withColumn(out, F.concat(F.col(out), here))
    return done


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", **how) -> DataFrame:
    """The documents in which no benchmark item occurs."""
    (out,) = unused(docs.columns, "__spans")
    return with_spans(docs, benchmark, text_col, out, **how).where(F.size(out) == 0).drop(out)


def digest(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of the query: doc_id, item_id, start_char, end_char, edits for every occurrence."""
    found = with_spans(docs.select("doc_id", "text"), benchmark).select("doc_id", F.explode("spans").alias("s"))
    return found.select("doc_id", "s.item_id", F.col("s.start").alias("start_char"), F.col("s.end").alias("end_char"), "s.edits")
