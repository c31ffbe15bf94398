"""Fuzzy ratios (100 * 2 * LCS / (m + n)) by bit-parallel longest common subsequences, as Arrow UDFs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from quirework.functions import slices


def lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence, a column of bits at a time."""
    masks: dict[str, int] = {}
    for i, c in enumerate(a):
        masks[c] = masks.get(c, 0) | 1 << i
    full, s = (1 << len(a)) - 1, (1 << len(a)) - 1
    for c in b:
        u = s & masks.get(c, 0)
        s = (s + u | s - u) & full
    return len(a) - s.bit_count()


def ratio(a: str, b: str) -> float:
    return 200.0 * lcs(a, b) / (len(a) + len(b)) if a and b else 0.0 if a or b else 100.0


def token_sort_ratio(a: str, b: str) -> float:
    return ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def _advance(s: np.ndarray, m: np.ndarray) -> None:
    """One column of bits for many strings at once, as in lcs: s and m have a row for each 64 bits, the carry goes from row to row."""
    carry = None
    for row, mask in zip(s, m, strict=True):
        u = row & mask
        t = row + u
        over = t < u
        if carry is not None:
            t += carry
            over |= t < carry
        row[:] = t | (row & ~u)
        carry = over.astype(np.uint64)


#: Windows that are compared before others are left out by what they found.
PILOT = 64


def _left(s: np.ndarray, size: int) -> np.ndarray:
    """Bits that are still set among the first `size`: these characters are in no common subsequence."""
    last = np.uint64((1 << (size - 64 * (len(s) - 1))) - 1)
    return sum((np.bitwise_count(r) for r in s[:-1]), np.bitwise_count(s[-1] & last)).astype(np.int64)


def _split(mask: int, rows: int) -> list[int]:
    return [mask >> 64 * r & 0xFFFFFFFFFFFFFFFF for r in range(rows)]


def partial_ratio(a: str, b: str, least: float = 0.0) -> float:
    """The best ratio of the shorter text with a window of its length in the longer, windows cut at the ends included. 0 may stand for less than `least`.

    Characters that only one side has are in no common subsequence: without any other the answer is known, and with few others next to no window can reach `least`,
    or more than the windows with most of them."""
    short, long = (a, b) if len(a) <= len(b) else (b, a)
    m, n = len(short), len(long)
    if not m:
        return 0.0 if n else 100.0
    if short in long:
        return 100.0
    known = {c: c in long for c in set(short)}
    kept = "".join(c for c in short if known[c])
    # a window of `size` has at most min(kept, size) characters in common, and the ratio of that is greatest for size = kept
    if not kept or 200.0 * len(kept) / (m + len(kept)) < least:
        return 0.0
    k = len(kept)
    rows = -(-k // 64)
    masks: dict[str, int] = {}
    for i, c in enumerate(kept):
        masks[c] = masks.get(c, 0) | 1 << i
    points, codes = np.frombuffer(long.encode("utf-32-le", "surrogatepass"), np.uint32), np.zeros(n, np.intp)
    for number, c in enumerate(masks, 1):
        codes[points == ord(c)] = number
    # window w covers the places w - m + 1 to w of the longer text; hits are its characters that both sides have
    at = np.arange(n + m - 1)
    lo, hi = np.maximum(0, at - m + 1), np.minimum(at + 1, n)
    before = np.concatenate(([0], np.cumsum(codes > 0)))
    most = 200.0 * np.minimum(before[hi] - before[lo], k) / (m + hi - lo)
    if len(masks) == 1:
        return float(most.max())
    table = np.array([[0] * rows, *(_split(masks[c], rows) for c in masks)], np.uint64).T
    padded = np.zeros((rows, n + 2 * (m - 1)), np.uint64)
    padded[:, m - 1 : m - 1 + n] = table[:, codes]

    def best(which: np.ndarray) -> float:
        if dense := 4 * len(which) > len(at):
            which = at
        s = np.full((rows, len(which)), 0xFFFFFFFFFFFFFFFF, np.uint64)
        for j in range(m):
            _advance(s, padded[:, j : j + len(at)] if dense else padded[:, which + j])
        return float((200.0 * (k - _left(s, k)) / (m + hi[which] - lo[which])).max())

    if most.max() < least:
        return 0.0
    if 2 * k > m:
        return best(np.flatnonzero(most >= least))
    # few characters are common: the windows with most hits first; of the others only those that could beat these
    first = np.argpartition(most, -PILOT)[-PILOT:] if len(most) > PILOT else at
    found = best(first)
    most[first] = -1.0
    rest = np.flatnonzero(most > max(found, np.nextafter(least, 0.0)))
    return max(found, best(rest)) if len(rest) else found


class Many:
    """Texts that others are compared with, one of these against all at a time."""

    def __init__(self, texts: list[str]):
        self.sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        self.number: dict[str, int] = {}
        # column j holds the j-th characters; 0 is behind the end
        self.codes = np.zeros((int(self.sizes.max(initial=0)), len(texts)), np.int32)
        for k, t in enumerate(texts):
            self.codes[: len(t), k] = [self.number.setdefault(c, len(self.number) + 1) for c in t]

    def lcs(self, text: str, which: np.ndarray) -> np.ndarray:
        """Lengths of the longest common subsequences of text with the texts numbered `which`."""
        rows = max(1, -(-len(text) // 64))
        table = np.zeros((rows, len(self.number) + 1), np.uint64)
        for i, c in enumerate(text):
            if k := self.number.get(c):
                table[i // 64, k] |= np.uint64(1 << i % 64)
        s = np.full((rows, len(which)), 0xFFFFFFFFFFFFFFFF, np.uint64)
        for column in self.codes[: int(self.sizes[which].max(initial=0))]:
            _advance(s, table[:, column[which]])
        return len(text) - _left(s, len(text)) if text else np.zeros(len(which), np.int64)


def _pairwise(f):
    def made(a: Column, b: Column) -> Column:
        def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
            for part in (p for cols in batches for p in slices.rows(cols)):
                yield pa.array([None if p is None or q is None else f(p, q) for p, q in part], pa.float64())

        run.__annotations__ = {"batches": Iterator[tuple[pa.Array, pa.Array]], "return": Iterator[pa.Array]}
        return F.arrow_udf(run, "double")(a, b)

    return made


indel = _pairwise(ratio)
token_sort = _pairwise(token_sort_ratio)
partial = _pairwise(partial_ratio)


def _author(author: str, text: str, least: float = 0.0) -> float:
    return max(partial_ratio(author, text, least), token_sort_ratio(author, text[: 4 * len(author) + 40]))


author_score = _pairwise(_author)


def in_text(needle: Column, text: Column, author: bool = False) -> Column:
    """0 to 1: how well a normalised needle occurs in a normalised text; the exact case is answered without Python's work."""
    rest = F.when((needle == "") | (text == "") | F.contains(text, needle), F.lit(None)).otherwise(text)
    score = (author_score if author else partial)(needle, rest)
    return F.when((needle == "") | (text == ""), 0.0).when(F.contains(text, needle), 1.0).otherwise(score / 100)


def standing(title: Column, author: Column, page: Column, bound: float) -> Column:
    """Do a normalised title and an author (null: there is none) both stand in a normalised page with at least `bound`? Python sees only what the page doesn't contain, the
    author only where the title stands, and of ratios only if they reach the bound."""
    contained = lambda c: (c != "") & F.contains(page, c)
    by = F.coalesce(contained(author), author.isNull())
    rest = F.coalesce((title != "") & (page != "") & F.coalesce(author != "", F.lit(True)) & ~(contained(title) & by), F.lit(False))
    reaches = lambda score, c, p: c is None or score(c, p, 100 * bound - 1e-9) / 100 >= bound

    def run(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for part in (p for cols in batches for p in slices.rows(cols)):
            yield pa.array([None if p is None else reaches(partial_ratio, t, p) and reaches(_author, a, p) for t, a, p in part], pa.bool_())

    run.__annotations__ = {"batches": Iterator[tuple[pa.Array, ...]], "return": Iterator[pa.Array]}
    found = F.arrow_udf(run, "boolean")(F.when(rest & ~contained(title), title), F.when(rest & ~by, author), F.when(rest, page))
    return F.when(rest, found).otherwise(F.coalesce(contained(title) & by, F.lit(False)))


def _best(score):
    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for pairs in (p for cols in batches for p in slices.rows(cols)):
            yield pa.array([None if n is None or t is None else max((score(a, b) for a in n for b in t if a and b), default=0.0) for n, t in pairs], pa.float64())

    run.__annotations__ = {"batches": Iterator[tuple[pa.Array, pa.Array]], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, "double")


def best_in_texts(needles: Column, texts: Column, author: bool = False) -> Column:
    """0 to 1: the best of how well any of the normalised needles occurs in any of the normalised texts. Python sees only rows in which none is contained."""
    joined = F.array_join(texts, "\x00")
    exact = F.exists(needles, lambda n: (n != "") & F.contains(joined, n))
    some = F.exists(needles, lambda n: n != "") & F.exists(texts, lambda t: t != "")
    score = _best(_author if author else partial_ratio)(needles, F.when(some & ~exact, texts))
    return F.when(~some, 0.0).when(exact, 1.0).otherwise(score / 100)


def best_pair(left: Column, right: Column) -> Column:
    """0 to 1: the best token-sorted ratio over all pairs of two arrays; equal elements are found without Python."""
    return F.when(F.arrays_overlap(left, right), 1.0).otherwise(_best(token_sort_ratio)(F.when(~F.arrays_overlap(left, right), left), right) / 100)
