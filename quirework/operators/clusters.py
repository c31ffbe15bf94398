"""Order-dependent clusters of claimants of one place."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirework.functions import constants as C
from quirework.functions import text
from quirework.functions.fuzzy import token_sort_ratio
from quirework.operators import similar

_ALIKE = 100 * C.SAME_BOOK
#: Grams are taken in the order of their numbers: no counts of a place are known while it passes by.
_EQUAL = np.zeros(similar.SLOTS, np.int64)


@lru_cache(1 << 16)
def _alike(a: str, b: str) -> bool:
    return a == b or token_sort_ratio(a, b) >= _ALIKE


def _key(title: str) -> str:
    return " ".join(sorted(title.split()))


@lru_cache(1 << 14)
def _grams(title: str) -> tuple[int, ...]:
    return tuple(similar.rarest(_key(title), _EQUAL, _ALIKE, similar.gram_size(_ALIKE)))


class _Place:
    """The clusters of one place while its records pass by in order of id. Of a cluster only its base and its size are held: as ids rise, the base is the
    first record until one with a number comes, and then stays. Bases are found by their titles' grams: two titles that are alike share one of the first few of each (see `similar`), so
    a record is compared with candidates only, in the clusters' order."""

    def __init__(self, dest: str):
        self.dest, self.base, self.size, self.by_isbn = dest, [], [], {}
        self.by_gram: dict[int, list[int]] = {}
        self.by_key: dict[str, list[int]] = {}

    def _known(self, at: int) -> None:
        """Cluster `at` has a new base; places of an earlier one stay, and do no harm."""
        for g in _grams(self.base[at]["title"] or ""):
            self.by_gram.setdefault(g, []).append(at)
        self.by_key.setdefault(_key(self.base[at]["title"] or ""), []).append(at)

    def _candidates(self, r: dict) -> list[int]:
        found = set(self.by_key.get(_key(r["title"] or ""), ()))
        for g in _grams(r["title"] or ""):
            found.update(self.by_gram.get(g, ()))
        return sorted(found)

    def _fits(self, base: dict, r: dict) -> bool:
        if not (base["title"] and r["title"]) or base["year"] is not None and r["year"] is not None and base["year"] != r["year"]:
            return False
        return _alike(base["title"], r["title"]) and any(_alike(x, y) for x in base["authors"] or () for y in r["authors"] or ())

    def take(self, r: dict) -> None:
        numbered = self.by_isbn.get(r["isbn"]) if r["isbn"] else None
        stop = len(self.base) if numbered is None else numbered
        at = next((i for i in self._candidates(r) if i < stop and self._fits(self.base[i], r)), numbered)
        if at is None:
            at = len(self.base)
            self.base.append(r)
            self.size.append(0)
        self.size[at] += 1
        if self.base[at] is r:
            self._known(at)
        elif r["isbn"] and not self.base[at]["isbn"]:
            self.base[at] = r
            self._known(at)
        if r["isbn"] and self.base[at] is r:
            self.by_isbn[r["isbn"]] = min(at, self.by_isbn.get(r["isbn"], at))

    def rows(self) -> list[tuple]:
        return [(self.dest, i, b["id"], n) for i, (b, n) in enumerate(zip(self.base, self.size, strict=True))]


def greedy(claims: DataFrame) -> DataFrame:
    """(dest, cluster, base_id, members): records in order of id join the first cluster whose base (valid ISBN, then lowest id) is the same book.

    The order is the meaning, so a place is one stream: records are dealt by place, sorted on disk if need be, and pass through in Arrow batches; no place
    is gathered. Records without an id come last."""
    norm = claims.select("dest", "id", text.normalise(F.col("title")).alias("title"), F.transform("authors", text.normalise).alias("authors"), "isbn", "year")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, done = None, []
        for b in batches:
            for r in b.to_pylist():
                if place is None or place.dest != r["dest"]:
                    done += place.rows() if place else []
                    place = _Place(r["dest"])
                place.take(r)
            if len(done) > 10_000:
                yield _batch(done)
                done = []
        yield _batch(done + (place.rows() if place else []))

    dealt = norm.repartition("dest").sortWithinPartitions("dest", F.col("id").asc_nulls_last())
    return dealt.mapInArrow(run, "dest string, cluster long, base_id long, members long")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["dest", "cluster", "base_id", "members"])
