"""Quality rules: base rules, and a hashed n-gram log-likelihood ratio between a trusted target and the raw corpus.

Word unigrams and bigrams are hashed into `buckets` counters. One scan counts them over every document (the raw
multinomial) and over the trusted documents (the target: rows of `labels` with quality 1). The ratio
of a text is the sum over its n-grams of ln(p_target / p_raw), divided by their number; a document is kept if
it passes the base rules and its ratio is at least `threshold`, the same number for every document and corpus.

The target is fitted on at most TRUSTED_ROWS labelled rows, the first by hash of their id (a documented bound, so that
their ids may be broadcast); the raw counts cover all documents. Counting is pre-aggregated per task into at most
`buckets` rows; what reaches the driver are 2 x buckets counters, a constant. Scoring has no shuffle: the weights are
a literal array and all rules are expressions on one row, whatever its source. No Python runs on executors.

Odd input: null or blank text has no words, fails the base rules and has ratio 0; rows without a label, labels without a row,
a null id: not trusted; without trusted rows or without words all weights are 0, so the base rules alone decide;
repeated rows are counted and judged each; extra columns are kept.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirework.llm.common import unused, words

BUCKETS = 1 << 17
TRUSTED_ROWS = 20_000
THRESHOLD = -0.3
#: Pseudo-count of a bucket, added to the target's count and to the count expected from the raw corpus.
PRIOR = 2.0


def _grams(h: str, buckets: int) -> Column:
    """Bucket of each unigram and bigram, from the array of word hashes."""
    one = f"transform({h}, x -> cast(pmod(x, {buckets}) as int))"
    two = f"transform({h}, (x, i) -> cast(pmod(xxhash64(x, get({h}, i + 1)), {buckets}) as int))"
    return F.expr(f"concat({one}, slice({two}, 1, greatest(size({h}) - 1, 0)))")


def trusted_ids(labels: DataFrame, rows: int = TRUSTED_ROWS) -> DataFrame:
    ids = labels.where("quality = 1 and doc_id is not null").select(F.col("doc_id").cast("long").alias("__trusted")).distinct()
    return ids.orderBy(F.xxhash64("__trusted"), "__trusted").limit(rows)


def gram_counts(docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(b, raw, target): occurrences of each bucket in all documents, and in the trusted ones."""
    h = F.transform(words(F.col(text_col)), lambda w: F.xxhash64(w))
    hashed = docs.select(F.col(id_col).cast("long").alias("__id"), h.alias("__h"))
    known = hashed.join(F.broadcast(trusted_ids(labels)), F.col("__id") == F.col("__trusted"), "left")
    grams = known.select(F.col("__trusted").isNotNull().cast("long").alias("t"), F.explode(_grams("__h", buckets)).alias("b"))
    return grams.groupBy("b").agg(F.count("*").alias("raw"), F.sum("t").alias("target"))


def weights(counts: DataFrame, buckets: int = BUCKETS, prior: float = PRIOR) -> list[float]:
    """ln(p_target / p_raw) of each bucket, both smoothed at the target's scale: rare n-grams say little."""
    raw, target = [0] * buckets, [0] * buckets
    for r in counts.collect():  # at most `buckets` rows
        raw[r.b], target[r.b] = r.raw, r.target
    n_raw, n_target = sum(raw), sum(target)
    if not n_raw or not n_target:
        return [0.0] * buckets
    share = n_target / n_raw
    return [math.log((t + prior) / (r * share + prior)) for r, t in zip(raw, target, strict=True)]


def _literal(values: list[float]) -> str:
    return "cast(split('" + ",".join(f"{v:.6g}" for v in values) + "', ',') as array<double>)"


def judge(docs: DataFrame, weight: list[float], threshold: float = THRESHOLD, text_col: str = "text", out: str = "quality") -> DataFrame:
    """docs with a column `out`: a struct of n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, llr, base_failed, kept."""
    if out in docs.columns:
        raise ValueError(f"docs has a column {out}; name another")
    buckets = len(weight)
    w, h, g, s, c, p, rep, llr, dup = unused([*docs.columns, out], *(f"__q_{n}" for n in ("words", "hash", "grams", "sorted", "maybe", "twice", "repeat", "llr", "dup")))
    text = F.coalesce(F.col(text_col), F.lit(""))
    d = docs.withColumn(w, words(F.col(text_col)))
    d = d.withColumn(h, F.transform(w, lambda x: F.xxhash64(x)))
    windows = f"transform(sequence(0, greatest(size({h}) - 5, 0)), i -> xxhash64(get({h},i), get({h},i+1), get({h},i+2), get({h},i+3), get({h},i+4)))"
    d = d.withColumn(g, F.expr(f"if(size({h}) < 5, cast(array() as array<bigint>), {windows})"))
    # windows found twice: equal neighbours in the sorted array of (hash, position). A first sort packs both into one long each, which costs low bits of the
    # hash; windows that are equal in the rest are the only ones that can be equal at all, and only these are sorted by all 64 bits
    bits = f"length(bin(size({g})))"
    packed = f"sort_array(transform({g}, (x, i) -> shiftleft(x, {bits}) | cast(i as bigint)))"
    d = d.withColumn(s, F.expr(f"if(size(array_distinct({g})) = size({g}), cast(array() as array<bigint>), {packed})"))
    high = lambda x: f"shiftrightunsigned({x}, {bits})"
    twice = f"coalesce({high('x')} = {high(f'get({s}, i + 1)')}, false) or coalesce({high('x')} = {high(f'get({s}, i - 1)')}, false)"
    at = f"cast(x & (shiftleft(1L, {bits}) - 1L) as int)"
    d = d.withColumn(c, F.expr(f"array_compact(transform({s}, (x, i) -> if({twice}, {at}, null)))"))
    d = d.withColumn(c, F.expr(f"sort_array(transform({c}, i -> struct(get({g}, i) as h, i as i)))"))
    same = f"coalesce(x.h = get({c}, j + 1).h, false) or coalesce(x.h = get({c}, j - 1).h, false)"
    d = d.withColumn(p, F.expr(f"sort_array(array_compact(transform({c}, (x, j) -> if({same}, x.i, null))))"))
    covered = f"aggregate(transform({p}, (x, i) -> least(5, coalesce(get({p}, i + 1) - x, 5))), 0L, (a, x) -> a + x)"
    d = d.withColumn(rep, F.expr(covered))
    score = F.aggregate(_grams(h, buckets), F.lit(0.0), lambda a, b: a + F.get(F.expr(_literal(weight)), b))
    n = F.greatest(2 * F.size(h) - 1, F.lit(1))
    d = d.withColumn(llr, F.round(score / n, 9))
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.btrim(x, F.lit(" \t\n\x0b\x0c\r")) != "")
    d = d.withColumn(dup, lines)
    n_words, repeat = F.size(w).cast("long"), F.col(rep)
    failed = (n_words < 10) | (100 * repeat > 20 * n_words)
    found = F.struct(
        n_words.alias("n_words"), F.char_length(F.array_join(w, "")).cast("long").alias("word_chars"),
        F.regexp_count(text, F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size(dup) - F.size(F.array_distinct(dup))).cast("long").alias("n_dup_lines"),
        repeat.alias("n_repeat_words"), F.col(llr).alias("llr"), failed.alias("base_failed"),
        (~failed & (F.col(llr) >= threshold)).alias("kept"),
    )
    return d.select(*[F.col(f"`{c}`") for c in docs.columns], found.alias(out))


def rules(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, buckets: int = BUCKETS, id_col: str = "doc_id", text_col: str = "text", out: str = "quality") -> DataFrame:
    """Fit the two multinomials on docs and labels, then judge docs."""
    return judge(docs, weights(gram_counts(docs, labels, buckets, id_col, text_col), buckets), threshold, text_col, out)


def keep_good(docs: DataFrame, labels: DataFrame, **how) -> DataFrame:
    """The documents that the rules keep. The filter also reads a nondeterministic column, or the optimiser would push it below
    the rules' projections and copy each of them into it many times over."""
    pin, out = unused(docs.columns, "__q_pin", "__q_found")
    judged = rules(docs, labels, out=out, **how).select("*", F.spark_partition_id().alias(pin))
    return judged.where(F.col(out)["kept"] & (F.col(pin) >= 0)).select(*[F.col(f"`{c}`") for c in docs.columns])


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The columns of the query."""
    got = rules(docs.select("doc_id", "text"), labels)
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "llr")
    return got.select("doc_id", *[F.col(f"quality.{n}").alias(n) for n in names])
