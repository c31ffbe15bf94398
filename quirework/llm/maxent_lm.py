"""Language-model scoring with a hashed maximum-entropy model and a class-factored softmax.

P(word | history) = P(class | history) * P(word | class, history). The HEAD most frequent training tokens fill HEAD_CLASSES classes of
equal size by rank; all other tokens belong to TAIL_CLASSES classes by a hash of their first two bytes and the last.
The class, and a head word within its class, come from log-linear models of hashed features of the history: the
word before (w1), the one before that (w2, a skip) and the pair (w2, w1). Within a tail class a token has its
smoothed share of the class' training tokens, so every token of the corpus counts, however rare.

Gathered from all training documents: exact counts of every token (one shuffle, pre-aggregated), from which come the base
score, the head, the class sizes and the starting weights; and the weights themselves. Features are hashed into as many rows as the square root of
the training tokens, rounded up to a power of two (4,096 at least): 384 bytes a row, so 25 MB for 30 GB of text and ten times that for a hundred times
the text. Training visits each training document once, in ROUNDS rounds: every
task updates its own copy of the weights by AdaGrad on mini-batches, and the changes, weighted by how often a row was
used, are summed by the cluster row by row before the next round. A task learns from at least ROW_TOKENS tokens for each row, so what the tasks hand on stays
below a fixed share of the text. Which texts meet in a task depends on how the table is split, and so, slightly, do the weights. Scoring runs in
numpy batches; tokens of at least 1/HEAVY of the training tokens (so at most HEAVY of them) are looked up in the task, the others
are joined with the counts by their 64-bit hashes (of a thousand million distinct ones, two meet by chance with probability 0.03), in a merge join, which
spills, and whose skewed keys (a token that is frequent only in held-out texts) Spark splits.

Odd input: a null text is empty and has one token, its end; a null id counts as the empty id; repeated rows are learned from and scored
each; without training documents every token is unknown and the model is uniform over classes; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from itertools import repeat
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirework.llm.common import written

HEAD, HEAD_CLASSES, TAIL_CLASSES = 1024, 16, 16
HEAVY, ROUNDS, DIM, ROW_TOKENS = 1 << 18, 2, 1 << 12, 256
BATCH, RATE = 4096, 0.25
#: The token that ends a text; no word has it.
END = "\n"
_CLASSES, _SIZE = HEAD_CLASSES + TAIL_CLASSES, HEAD // HEAD_CLASSES
_U = np.uint64
#: Tokens scored at once, and characters of texts taken together; they bound memory.
_BLOCK, _CHARS = 1 << 15, 1 << 18


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 5 == 1


def _tail_class(token: Column) -> Column:
    raw = token.cast("binary")
    return (F.crc32(F.concat(F.substring(raw, 1, 2), F.substring(raw, -1, 1))) % TAIL_CLASSES).cast("int")


class _Tails(dict):
    """The tail class of a token's first two bytes and its last."""

    def __missing__(self, ends: bytes) -> int:
        k = self[ends] = crc32(ends) % TAIL_CLASSES
        return k


_TAILS = _Tails()


def _tail_class_of(token: bytes) -> int:
    return _TAILS[token[:2] + token[-1:]]


def _words(text: str | None) -> list[bytes]:
    """Lower-cased words (bytes methods know ASCII only, as the contract wants) and the end."""
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    w.append(END.encode())
    return w


def token_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(token, c) over docs, the end of each text included; counted by batch in the task before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()
        for b in batches:
            for t in b.column(0):
                found.update(_words(t.as_py()))
                if len(found) >= 200_000:
                    yield _counted(found)
                    found = Counter()
        yield _counted(found)

    raw = docs.select(F.col(text_col).alias("text")).mapInArrow(run, "raw binary, c long")
    return raw.groupBy("raw").agg(F.sum("c").alias("c")).select(F.col("raw").cast("string").alias("token"), "c")


def _counted(found: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(found.keys(), pa.binary()), pa.array(found.values(), pa.int64())], ["raw", "c"])


def rows_for(tokens: int) -> int:
    """Hashed rows for so many training tokens: a power of two of at least their square root."""
    return max(DIM, 1 << (math.isqrt(max(tokens - 1, 0))).bit_length())


class Model:
    """What scoring needs in a task."""

    def __init__(self, heavy: list[tuple[str, int]], total: int, distinct: int, tail_n: list[int], tail_v: list[int], dim: int | None = None):
        self.dim = dim or rows_for(total)
        heavy = sorted(heavy, key=lambda x: (-x[1], x[0]))
        head = heavy[:HEAD]
        self.total, self.distinct = total, distinct
        self.index = {w.encode("utf-8", "surrogatepass"): i for i, (w, _) in enumerate(heavy)}
        self.count = np.array([c for _, c in heavy], np.float64)
        self.cls = np.array([i // _SIZE if i < HEAD else HEAD_CLASSES + _tail_class_of(w.encode("utf-8", "surrogatepass")) for i, (w, _) in enumerate(heavy)], np.int32)
        self.mass = np.array([n + 0.5 * (v + 1) for n, v in zip(tail_n, tail_v, strict=True)])
        # rows of wc: hashed features, then the bias; of ww: hashed features, then a bias for each head class
        self.wc, self.ww = np.zeros((self.dim + 1, _CLASSES), np.float32), np.zeros((self.dim + HEAD_CLASSES, _SIZE), np.float32)
        size = np.full(HEAD, -30.0)
        size[: len(head)] = np.log([c for _, c in head]) if head else []
        self.ww[self.dim:] = size.reshape(HEAD_CLASSES, _SIZE)
        sums = np.exp(size).reshape(HEAD_CLASSES, _SIZE).sum(axis=1)
        self.wc[self.dim] = np.log(np.concatenate([np.maximum(sums, 1e-9), self.mass]))
        self.wc[self.dim] -= self.wc[self.dim].max()

    def read(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
        """Of the texts' tokens in a row: index among the heavy ones (-1: rare), class, rows of the hashed features of the history (which
        begins anew at every text); where each text begins; the rare tokens."""
        w: list[bytes] = []
        starts = []
        for t in texts:
            starts.append(len(w))
            w += _words(t)
        at = np.fromiter(map(self.index.get, w, repeat(-1)), np.int64, len(w))
        cls = self.cls[at] if len(self.cls) else np.zeros(len(w), np.int32)
        few = np.flatnonzero(at < 0)
        rare = [w[i] for i in few.tolist()]
        cls[few] = np.array([_TAILS[t[:2] + t[-1:]] for t in rare], np.int32) + HEAD_CLASSES
        first = np.array(starts, np.int64)
        return at, cls, self.features(at, cls, first), first, rare

    def features(self, at: np.ndarray, cls: np.ndarray, starts: np.ndarray) -> np.ndarray:
        own = np.where(at >= 0, at + _CLASSES + 1, cls + 1).astype(_U)
        w1, w2 = np.zeros_like(own), np.zeros_like(own)
        w1[1:], w2[2:] = own[:-1], own[:-2]
        w1[starts] = w2[starts] = 0
        second = starts + 1
        w2[second[second < len(own)]] = 0
        with np.errstate(over="ignore"):
            pair = w1 * _U(0x9E3779B97F4A7C15) + w2 * _U(0xC2B2AE3D27D4EB4F)
            raw = [w1, w2 + _U(1 << 20), pair]
            return np.stack([((x * _U(0xD6E8FEB86659FD93)) ^ (x >> _U(7))) * _U(0x9E3779B97F4A7C15) >> _U(65 - self.dim.bit_length()) for x in raw], axis=1).astype(np.int64)

    def within(self, feats: np.ndarray, cls: np.ndarray) -> np.ndarray:
        """Rows of the features together with a head class."""
        return (feats * 31 + cls[:, None].astype(np.int64) * 1009 + 7) & (self.dim - 1)

    @staticmethod
    def _softmax(table: np.ndarray, rows: np.ndarray, bias: np.ndarray) -> np.ndarray:
        z = table.take(rows[:, 0], axis=0)
        for f in range(1, rows.shape[1]):
            z += table.take(rows[:, f], axis=0)
        z += bias
        top = z  # the maximum of each row, by halves: far faster than along the short axis
        while (n := top.shape[1]) > 1:
            top = np.maximum(top[:, : n - n // 2], top[:, n // 2 :])
        z -= top
        np.exp(z, out=z)
        z *= 1 / np.einsum("ij->i", z)[:, None]
        return z

    def predict(self, at: np.ndarray, cls: np.ndarray, feats: np.ndarray) -> np.ndarray:
        """log10 of each token's probability, but for the share of a rare token within its class."""
        out = np.empty(len(at))
        for lo in range(0, len(at), _BLOCK):
            a, c, f = at[lo : lo + _BLOCK], cls[lo : lo + _BLOCK], feats[lo : lo + _BLOCK]
            p = self._softmax(self.wc, f, self.wc[self.dim])
            got = np.log10(np.maximum(p[np.arange(len(a)), c], 1e-30), dtype=np.float64)
            head = np.flatnonzero((a >= 0) & (a < HEAD))
            if len(head):
                p = self._softmax(self.ww, self.within(f[head], c[head]), self.ww[self.dim + c[head]])
                got[head] += np.log10(np.maximum(p[np.arange(len(head)), a[head] % _SIZE], 1e-30), dtype=np.float64)
            tail = np.flatnonzero(a >= HEAD)
            if len(tail):
                got[tail] += np.log10((self.count[a[tail]] + 0.5) / self.mass[c[tail] - HEAD_CLASSES])
            out[lo : lo + _BLOCK] = got
        return out


class Learner:
    """One task's copy of the weights."""

    def __init__(self, model: Model):
        self.m, self.old = model, (model.wc.copy(), model.ww.copy())
        self.now = (model.wc.copy(), model.ww.copy())
        self.used = (np.zeros(model.dim + 1, np.float64), np.zeros(model.dim + HEAD_CLASSES, np.float64))
        self.acc = (np.full(model.dim + 1, 1.0, np.float32), np.full(model.dim + HEAD_CLASSES, 1.0, np.float32))
        self.small = model.dim + HEAD_CLASSES <= 1 << 16

    def _update(self, t: int, rows: np.ndarray, error: np.ndarray) -> None:
        """One step on the rows of one feature. The errors of equal rows are summed by pairs: each pass adds every second one of a row to the one before it."""
        order = np.argsort(rows.astype(np.uint16), kind="stable") if self.small else np.argsort(rows.astype(np.uint32))
        flat, g = rows[order], error.take(order, axis=0)
        first = np.flatnonzero(np.concatenate(([True], flat[1:] != flat[:-1])))
        n = np.diff(first, append=len(flat))
        live, place = np.arange(len(flat)), np.arange(len(flat)) - np.repeat(first, n)
        while (odd := np.flatnonzero(place & 1)).size:
            g[live[odd - 1]] += g[live[odd]]
            even = np.flatnonzero(place & 1 == 0)
            live, place = live[even], place[even] >> 1
        self._step(t, flat[first], g[first], n)

    def _step(self, t: int, row: np.ndarray, g: np.ndarray, n: np.ndarray | int) -> None:
        self.used[t][row] += n
        seen = self.acc[t][row] + np.einsum("ij,ij->i", g, g)
        self.acc[t][row] = seen
        g = g * (-RATE / np.sqrt(seen))[:, None]
        g += self.now[t].take(row, axis=0)
        self.now[t][row] = g

    def learn(self, at: np.ndarray, cls: np.ndarray, feats: np.ndarray) -> None:
        """One mini-batch."""
        wc, ww = self.now
        dim = self.m.dim
        e = Model._softmax(wc, feats, wc[dim])
        e[np.arange(len(at)), cls] -= 1
        for f in range(feats.shape[1]):
            self._update(0, feats[:, f], e)
        self._step(0, np.array([dim]), e.sum(axis=0, keepdims=True), len(at))
        head = np.flatnonzero((at >= 0) & (at < HEAD))
        if len(head):
            c = cls[head]
            rows = self.m.within(feats[head], c)
            e = Model._softmax(ww, rows, ww[dim + c])
            e[np.arange(len(head)), at[head] % _SIZE] -= 1
            for f in range(rows.shape[1]):
                self._update(1, rows[:, f], e)
            self._update(1, dim + c, e)

    def changes(self) -> Iterator[pa.RecordBatch]:
        for t in (0, 1):
            rows = np.flatnonzero(self.used[t])
            for lo in range(0, len(rows), 1024):
                r = rows[lo : lo + 1024]
                v = ((self.now[t][r] - self.old[t][r]) * self.used[t][r][:, None]).astype(np.float32)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(r) + 1, dtype=np.int32) * v.shape[1]), pa.array(v.ravel()))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(r), t, np.int32)), pa.array(r.astype(np.int32)), pa.array(self.used[t][r]), lists], ["t", "row", "n", "v"])


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS) -> tuple[Model, DataFrame]:
    """The model of all rows of docs, and the written table of their token counts (token, c, heavy)."""
    counts = written(token_counts(docs, text_col), "token-counts")
    total, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    heavy = counts.where(F.col("c") * HEAVY >= total).orderBy(F.desc("c"), "token").limit(HEAVY)
    rows = [(r.token, r.c) for r in heavy.collect()] if total else []
    head = {w for w, _ in sorted(rows, key=lambda x: (-x[1], x[0]))[:HEAD]}
    by = {r.k: (r.n, r.v) for r in counts.groupBy(_tail_class(F.col("token")).alias("k")).agg(F.sum("c").alias("n"), F.count("*").alias("v")).collect()}
    tail_n, tail_v = [by.get(k, (0, 0))[0] for k in range(TAIL_CLASSES)], [by.get(k, (0, 0))[1] for k in range(TAIL_CLASSES)]
    for w, c in rows:
        if w in head:
            k = _tail_class_of(w.encode("utf-8", "surrogatepass"))
            tail_n[k], tail_v[k] = tail_n[k] - c, tail_v[k] - 1
    model = Model(rows, total, distinct, tail_n, tail_v)
    for r in range(rounds if total else 0):
        # the cluster's cores are used whatever the rows
        part = docs.where(F.pmod(F.xxhash64(F.col(id_col), F.lit(r // rounds)), F.lit(rounds)) == r).select(F.col(text_col).alias("text"))
        part = part.coalesce(max(docs.sparkSession.sparkContext.defaultParallelism, total // (ROW_TOKENS * model.dim)))
        changes = part.mapInArrow(_learner(model), "t int, row int, n double, v array<float>")
        sums = [F.sum(F.coalesce(F.get("v", F.lit(i)), F.lit(0.0)).cast("double")).alias(f"v{i}") for i in range(max(_CLASSES, _SIZE))]
        for x in changes.groupBy("t", "row").agg(F.sum("n").alias("n"), *sums).toPandas().itertuples(index=False):
            w = (model.wc, model.ww)[x.t]
            w[x.row] += np.array(x[3 : 3 + w.shape[1]], np.float64) / x.n
    return model, counts


def _together(texts: Iterator[str | None]) -> Iterator[list[str | None]]:
    """Texts in lists of about _CHARS characters."""
    part: list[str | None] = []
    size = 0
    for t in texts:
        part.append(t)
        size += len(t or "")
        if size >= _CHARS:
            yield part
            part, size = [], 0
    if part:
        yield part


def _learner(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        learner = Learner(model)
        rest = None
        for part in _together(t.as_py() for b in batches for t in b.column(0)):
            now = model.read(part)[:3]
            now = tuple(np.concatenate(x) for x in zip(rest, now, strict=True)) if rest else now
            cut = len(now[0]) - len(now[0]) % BATCH
            for lo in range(0, cut, BATCH):
                learner.learn(*(x[lo : lo + BATCH] for x in now))
            rest = tuple(x[cut:] for x in now)
        if rest and len(rest[0]):
            learner.learn(*rest)
        yield from learner.changes()

    return run


def _scorer(model: Model):
    floor = model.total + 0.5 * (model.distinct + 1)
    names = ["uid", "id", "n_tokens", "n_known", "base", "score", "rare"]
    share = np.append(np.log10((model.count + 0.5) / floor), 0.0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            done = 0
            for part in _together(t.as_py() for t in b.column(2)):
                at, cls, feats, first, rare = model.read(part)
                n = np.diff(np.append(first, len(at)))
                few = np.add.reduceat((at < 0).astype(np.int64), first)
                base, score = (np.add.reduceat(x, first) for x in (share[at], model.predict(at, cls, feats)))
                ends = np.append(0, np.cumsum(few)).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(rare, pa.binary()))
                cols = [pa.array(x) for x in (n, n - few, base, score)]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(done, len(part)), b.column(1).slice(done, len(part)), *cols, lists], names)
                done += len(part)

    return run


def score(docs: DataFrame, model: Model, counts: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, n_known, base, score) of every row of docs."""
    rows = docs.select(F.monotonically_increasing_id().alias("uid"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = f"uid long, id {dict(docs.dtypes)[id_col]}, n_tokens long, n_known long, base double, score double, rare array<binary>"
    done = written(rows.mapInArrow(_scorer(model), schema), "scored")
    floor = model.total + 0.5 * (model.distinct + 1)
    mass = F.array(*[F.lit(float(m)) for m in model.mass])
    few = counts.where(F.col("c") * HEAVY < model.total).select(F.xxhash64("token").alias("h"), "c")
    token = F.col("raw").cast("string")
    rare = done.select("uid", F.explode("rare").alias("raw")).select("uid", F.xxhash64(token).alias("h"), _tail_class(token).alias("class"))
    rare = rare.join(few.hint("merge"), "h", "left")
    c = F.coalesce(F.col("c"), F.lit(0)).cast("double")
    share = F.log10((c + 0.5) / F.get(mass, F.col("class")))
    rare = rare.select("uid", (c > 0).cast("long").alias("k"), F.log10((c + 0.5) / F.lit(floor)).alias("b"), share.alias("s"))
    rare = rare.groupBy("uid").agg(F.sum("k").alias("k"), F.sum("b").alias("b"), F.sum("s").alias("s"))
    add = lambda x, y: F.col(x) + F.coalesce(F.col(y), F.lit(0))
    return done.drop("rare").join(rare, "uid", "left").select("id", "n_tokens", add("n_known", "k").alias("n_known"), add("base", "b").alias("base"), add("score", "s").alias("score"))


def digest(docs: DataFrame) -> DataFrame:
    """The columns of the query."""
    docs = docs.select("doc_id", "text")
    model, counts = fit(docs.where(~held_out(F.col("doc_id"))))
    got = score(docs, model, counts)
    return got.select(
        F.col("id").alias("doc_id"), held_out(F.col("id")).alias("held_out"), "n_tokens", "n_known",
        F.lit(model.total).cast("long").alias("train_tokens"), F.col("base").alias("base_score"), "score",
    )
