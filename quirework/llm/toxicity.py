"""Toxicity by cumulative-link ordinal regression.

Severity has the grades 0 to GRADES. P(severity > k) = sigmoid(w . x - theta_k): one weight vector for all thresholds, which
are kept in order (theta_k = theta_0 plus positive steps). The expected severity is the sum of these probabilities over k.

x is sparse: for each distinct word (lower case, without outer punctuation) and each of its prefixes of 4, 5 and 6
characters the logarithm of 1 + its count, at a hashed position; features are those that chi-squared finds tied to the toxic label,
with weights of at least 0.
The number of words enters as one dense feature, so that the base rate can follow length.

`labels` says only toxic or not. The training rows' grades follow from it: 0 if not toxic, else 1 to GRADES by the sum of
their toxic features, cut at the quantiles of the toxic rows. The model is fitted on at most SAMPLE_ROWS rows of each label, the first
by hash of the id (a documented bound); each label's rows weigh as many as there are in `labels`. All documents are scored, whole,
in the task that reads them, without a shuffle.

Odd input: null, empty or wordless texts have severity 0; without toxic or without clean labelled rows all severities are 0; labels of ids
that documents lacks, null labels and null ids are passed over; repeated rows are scored each; extra columns are kept.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

GRADES, SAMPLE_ROWS, DIM = 3, 4_000, 1 << 20
#: Chi-squared with one degree of freedom at p = 0.0001.
CHI2 = 15.1
#: A feature is at least so many times as frequent in toxic rows as in clean ones.
LIFT = 4
MIN_ROWS, STEPS, STEP, L2 = 3, 400, 0.05, 1e-6
#: A text is called toxic if it exceeds grade 0 with at least this probability.
TOXIC = 0.4
REMEMBER = 200_000
_EDGE = "".join(c for c in map(chr, range(0x250)) if not c.isalnum()) + "‘’“”„–—…•‹›"


def _positions(token: str) -> tuple[int, ...]:
    w = token.strip(_EDGE)
    if not w:
        return ()
    found = [w] + [w[:n] + "*" for n in (4, 5, 6) if len(w) >= n]
    return tuple(dict.fromkeys(crc32(f.encode("utf-8", "surrogatepass")) & (DIM - 1) for f in found))


@dataclass
class Model:
    at: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    weight: np.ndarray = field(default_factory=lambda: np.zeros(0))
    length: float = 0.0
    theta: np.ndarray = field(default_factory=lambda: np.full(GRADES, np.inf))


def counted(text: str | None, known: dict[str, tuple[int, ...]], of) -> tuple[Counter, int]:
    """Counts of a text's features as `of` names them, and its number of tokens. known is a bounded memory."""
    tokens = (text or "").lower().split()
    if len(known) > REMEMBER:
        known.clear()
    found: Counter = Counter()
    for w, f in zip(tokens, map(known.get, tokens), strict=True):
        if f is None:
            f = known[w] = of(w)
        if f:
            found.update(f)
    return found, len(tokens)


def _sampled(docs: DataFrame, labels: DataFrame, rows: int) -> tuple[DataFrame, dict[int, int]]:
    """The labelled documents to fit on: id, toxic, text; and the number of labels of each kind."""
    good = labels.where("doc_id is not null and toxic in (0, 1)").groupBy(F.col("doc_id").cast("long").alias("__id")).agg(F.max("toxic").cast("int").alias("__toxic"))
    size = {r[0]: r[1] for r in good.groupBy("__toxic").count().collect()}
    parts = [good.where(F.col("__toxic") == k).orderBy(F.xxhash64("__id"), "__id").limit(rows) for k in (0, 1)]
    chosen = parts[0].unionByName(parts[1])  # at most 2 x rows ids
    return docs.join(F.broadcast(chosen), F.col("doc_id") == F.col("__id"), "inner").select("__id", "__toxic", "text"), size


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> Model:
    sample, size = _sampled(docs.select("doc_id", "text"), labels, rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple[int, ...]] = {}
        for b in batches:
            feats, n = [], []
            for t in b.column(2):
                c, k = counted(t.as_py(), known, _positions)
                feats.append(np.array([list(c.keys()), list(c.values())], np.int32).tobytes())
                n.append(k)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(feats, pa.binary()), pa.array(n, pa.int64())], ["id", "toxic", "f", "n"])

    got = sample.mapInArrow(run, "id long, toxic int, f binary, n long").toPandas()
    got = got.sort_values("id", kind="stable").drop_duplicates("id")
    sets = [np.frombuffer(f, np.int32).reshape(2, -1)[0] for f in got.f]
    often = np.bincount(np.concatenate(sets), minlength=DIM) > 0.02 * len(sets) + 1 if sets else None
    # near copies would make every word of theirs a marker: of rows of one label with the same three smallest rare features one counts
    got["sign"] = [(c[:3] if len(c := np.sort(f[~often[f]])) else np.sort(f)).tobytes() for f in sets]
    got = got.drop_duplicates(["toxic", "sign"])
    y = got.toxic.to_numpy()
    if not (y == 0).any() or not (y == 1).any():
        return Model()
    pairs = [np.frombuffer(f, np.int32).reshape(2, -1) for f in got.f]
    row = np.repeat(np.arange(len(pairs)), [p.shape[1] for p in pairs])
    at, n = (np.concatenate([p[i] for p in pairs]).astype(np.int64) for i in (0, 1))
    return _train(row, at, n, got.n.to_numpy(), y, {k: size[k] / (y == k).sum() for k in (0, 1)})


def _train(row: np.ndarray, at: np.ndarray, n: np.ndarray, words: np.ndarray, y: np.ndarray, scale: dict[int, float]) -> Model:
    rows = len(y)
    pos, every = np.bincount(at[y[row] == 1], minlength=DIM), np.bincount(at, minlength=DIM)
    n1, n0 = (y == 1).sum(), (y == 0).sum()
    neg = every - pos
    with np.errstate(divide="ignore", invalid="ignore"):
        chi = rows * (pos * (n0 - neg) - neg * (n1 - pos)) ** 2.0 / (n1 * n0 * every * (rows - every).astype(float))
    chosen = np.flatnonzero((every >= MIN_ROWS) & (every < rows) & (chi >= CHI2) & (pos * n0 > LIFT * neg * n1))
    if not len(chosen):
        return Model()
    spot = np.full(DIM, -1)
    spot[chosen] = np.arange(len(chosen))
    keep = spot[at] >= 0
    row, col, n = row[keep], spot[at[keep]], n[keep]
    value, long = np.log1p(n), np.log1p(words) - 6
    amount = np.bincount(row, value, rows)
    cuts = np.quantile(amount[y == 1], np.arange(1, GRADES) / GRADES)
    grade = np.where(y == 1, 1 + np.searchsorted(cuts, amount, "right"), 0)
    weight = np.where(y == 1, scale[1], scale[0])
    weight = weight / weight.sum()
    # parameters: weights, length, first threshold, logarithms of the steps; Adam on the whole sample
    p = np.concatenate([np.zeros(len(chosen) + 1), [2.0], np.zeros(GRADES - 1)])
    m, v, k = np.zeros_like(p), np.zeros_like(p), len(chosen)
    for step in range(1, STEPS + 1):
        theta = p[k + 1] + np.concatenate([[0], np.cumsum(np.exp(p[k + 2 :]))])
        z = np.bincount(row, value * p[:k][col], rows) + p[k] * long
        s = 1 / (1 + np.exp(-np.clip(z[:, None] - theta, -40, 40)))
        # P(grade) is a difference of neighbours; the gradient of its logarithm in z and in the thresholds
        up, down = np.column_stack([np.ones(rows), s]), np.column_stack([s, np.zeros(rows)])
        i = np.arange(rows)
        prob = np.maximum(up[i, grade] - down[i, grade], 1e-12)
        du, dd = up[i, grade] * (1 - up[i, grade]), down[i, grade] * (1 - down[i, grade])
        dz = weight * (dd - du) / prob
        g = np.concatenate([np.bincount(col, value * dz[row], k) + L2 * p[:k], [(dz * long).sum()], np.zeros(GRADES)])
        dt = np.zeros(GRADES)
        np.add.at(dt, grade[grade > 0] - 1, (weight * du / prob)[grade > 0])
        np.add.at(dt, grade[grade < GRADES], -(weight * dd / prob)[grade < GRADES])
        g[k + 1] = dt.sum()
        for j in range(GRADES - 1):
            g[k + 2 + j] = dt[j + 1 :].sum() * np.exp(p[k + 2 + j])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        p = p - STEP * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        p[:k] = np.maximum(p[:k], 0)
    theta = p[k + 1] + np.concatenate([[0], np.cumsum(np.exp(p[k + 2 :]))])
    return Model(chosen, p[:k], float(p[k]), theta)


def score(docs: DataFrame, model: Model, text_col: str = "text", out: str = "toxicity") -> DataFrame:
    """docs with a struct of `severity` (expected grade), `above` (probability of exceeding each threshold) and `grade` (the likeliest)."""
    if out in docs.columns:
        raise ValueError(f"docs has a column {out}; name another")
    weight = dict(zip(model.at.tolist(), model.weight.tolist(), strict=True))

    def of(token: str) -> tuple[int, ...]:
        return tuple(f for f in _positions(token) if f in weight)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known: dict[str, tuple[int, ...]] = {}
        for a in batches:
            z, n = np.zeros(len(a)), np.zeros(len(a))
            for i, t in enumerate(a):
                c, n[i] = counted(t.as_py(), known, of)
                z[i] = sum(weight[f] * np.log1p(k) for f, k in sorted(c.items()))
            z += model.length * (np.log1p(n) - 6)
            with np.errstate(invalid="ignore"):
                s = np.where((n > 0)[:, None] & np.isfinite(model.theta), 1 / (1 + np.exp(-np.clip(z[:, None] - model.theta, -40, 40))), 0.0)
            p = -np.diff(np.column_stack([np.ones(len(a)), s, np.zeros(len(a))]), axis=1)
            above = pa.ListArray.from_arrays(pa.array(np.arange(len(a) + 1, dtype=np.int32) * GRADES), pa.array(s.ravel()))
            yield pa.StructArray.from_arrays([pa.array(s.sum(axis=1)), above, pa.array(p.argmax(axis=1).astype(np.int32))], ["severity", "above", "grade"])

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return docs.withColumn(out, F.arrow_udf(run, "struct<severity: double, above: array<double>, grade: int>")(F.col(text_col)))


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The columns of the query: doc_id, expected severity, likeliest grade, and toxic: above grade 0 with probability TOXIC or more."""
    got = score(docs.select("doc_id", "text"), fit(docs, labels))
    return got.select(
        "doc_id", F.round("toxicity.severity", 6).alias("severity"), F.col("toxicity.grade").alias("grade"),
        (F.get("toxicity.above", F.lit(0)) >= TOXIC).alias("toxic"),
    )
