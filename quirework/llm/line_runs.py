"""Line dedup with levelled sorted runs of line hashes.

All runs live in one table (run, h1, h2, n) in the shared folder, partitioned by run, and within a run bucketed and sorted by the 128-bit
hash of line keys; n is the number of documents that have the key. A bucket of one run meets the same bucket of another in one task, so
neither anti-joins nor compactions shuffle runs again.

A new batch becomes a sorted run of its own. It is merge-anti-joined with the settled runs, the hashes that already were found in `min_docs`
documents: nothing can change for these, so they are not counted again. What is left is added as a run of level 0. Once a level has `fanout` runs it is
compacted: counts of equal hashes are summed, those that reach `min_docs` go to a new settled run, the others to one run of the next level. Settled runs are
levelled and compacted in the same way, so a hash is rewritten at most once a level. A line is common if its hash is settled or its
counts over all levels reach `min_docs`. Without `min_docs` nothing is settled and counts stay exact; `fresh` then gives the lines of a batch that no run has.

A batch's run is reduced before its shuffle (a document counts once for a key, then partial counts), so a line that a third
of all documents share is a few rows. Lines that are dropped are looked up by hash, with their positions: the common
keys are broadcast only if their counted number is within BROADCAST_ROWS, else merge-joined. A text is
shuffled once, whole; every step on a text is linear in its lines.

Keys: the line with ASCII white space stripped at both ends and A-Z lower-cased. Odd input: a null or empty
text is one empty line, never dropped; `min_chars` keeps short keys; every row counts as a document, so repeated rows count
each; a null id is a value like others; empty tables give empty results; a document that loses all lines becomes an
empty text; extra columns of any name are kept. Two keys are taken as one if all 128 bits agree.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quirework.llm.common import SPACE, ascii_lower, join_small, scratch, unused, written

#: 16 bytes a row: at most 16 MB are broadcast.
BROADCAST_ROWS = 1_000_000


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(SPACE)))


def line_hash(key: Column) -> Column:
    """128 bits: XXH64 twice, the second seeded with the hash of a constant."""
    return F.struct(F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(5), key).alias("h2"))


def text_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _hashes(text: Column, min_chars: int) -> Column:
    """The hashes of a text's distinct keys."""
    keys = F.filter(F.array_distinct(F.transform(text_lines(text), line_key)), lambda k: F.char_length(k) >= min_chars)
    return F.transform(keys, line_hash)


def batch_counts(docs: DataFrame, text_col: str = "text", min_chars: int = 1, batch: Column | None = None) -> DataFrame:
    """(run, h1, h2, n): for each batch (0 if none is given) the documents that have each key."""
    run = F.lit(0) if batch is None else batch
    h = docs.select(run.cast("int").alias("run"), F.explode(_hashes(F.col(text_col), min_chars)).alias("h"))
    return h.select("run", "h.h1", "h.h2").groupBy("run", "h1", "h2").agg(F.count("*").alias("n"))


class LineRuns:
    """Levels of sorted runs under one folder. buckets: by default as many as the session has shuffle partitions, so that a side that is
    shuffled to meet them falls into the same ones."""

    def __init__(self, spark: SparkSession, path: str | None = None, fanout: int = 4, min_chars: int = 1, min_docs: int | None = None, buckets: int | None = None):
        self.spark, self.path, self.fanout = spark, path or scratch(spark, "line-runs"), fanout
        self.min_chars, self.min_docs = min_chars, min_docs
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.name = f"quirework_lines_{uuid.uuid4().hex}"
        self.levels: list[list[int]] = []
        self.settled: list[list[int]] = []
        self.made = 0

    def _append(self, rows: DataFrame) -> None:
        """Rows (run, h1, h2, n), already dealt to the buckets, as runs."""
        # hashes don't compress, and a codec's native buffers for hundreds of small files outgrow an executor
        w = rows.select("h1", "h2", "n", "run").write.mode("append").option("path", self.path).option("compression", "none")
        w.partitionBy("run").bucketBy(self.buckets, "h1", "h2").sortBy("h1", "h2").saveAsTable(self.name)

    def _runs(self, levels: list[list[int]]) -> DataFrame:
        """The rows (h1, h2, n) of these levels' runs."""
        if not self.made:
            return self.spark.createDataFrame([], "h1 long, h2 long, n long")
        return self.spark.table(self.name).where(F.col("run").isin([r for level in levels for r in level])).select("h1", "h2", "n")

    def _unsettled(self, rows: DataFrame) -> DataFrame:
        """Rows whose hash no settled run has: one merge anti-join, bucket by bucket."""
        if not any(self.settled):
            return rows
        return rows.join(self._runs(self.settled).select("h1", "h2").hint("merge"), ["h1", "h2"], "left_anti")

    def _sums(self, rows: DataFrame) -> DataFrame:
        return rows.groupBy("h1", "h2").agg(F.sum("n").alias("n"))

    def _next(self) -> int:
        self.made += 1
        return self.made

    def _put(self, levels: list[list[int]], run: int, level: int) -> None:
        """run as the newest of its level; compacts a full level into one run of the next."""
        while len(levels) <= level:
            levels.append([])
        levels[level].append(run)
        if len(levels[level]) < self.fanout:
            return
        rows, levels[level] = self._runs([levels[level]]), []
        if levels is self.settled:
            self._append(rows.withColumn("run", F.lit(up := self._next())))
        elif self.min_docs is None:
            self._append(self._sums(rows).withColumn("run", F.lit(up := self._next())))
        else:
            up, common = self._next(), self._next()
            self._append(self._sums(self._unsettled(rows)).withColumn("run", F.when(F.col("n") >= self.min_docs, common).otherwise(up)))
            self._put(self.settled, common, 0)
        self._put(levels, up, level + 1)

    def _take(self, run: int) -> None:
        """A batch's run into level 0, without what is settled."""
        if any(self.settled):
            rest = self._unsettled(self._runs([[run]]))
            self._append(rest.withColumn("run", F.lit(run := self._next())))
        self._put(self.levels, run, 0)

    def add(self, docs: DataFrame, text_col: str = "text") -> None:
        """One more batch."""
        run = self._next()
        counts = batch_counts(docs, text_col, self.min_chars).withColumn("run", F.lit(run))
        self._append(counts.repartition(self.buckets, "h1", "h2"))
        self._take(run)

    def load(self, docs: DataFrame, text_col: str = "text", batches: int = 4) -> None:
        """The same as `batches` calls of add() on a split of docs by text hash; their sorted runs are made in one scan."""
        part = F.pmod(F.xxhash64(F.col(text_col), F.lit(1)), F.lit(batches)) + self.made + 1
        self._append(batch_counts(docs, text_col, self.min_chars, part).repartition(self.buckets, "h1", "h2"))
        for run in [self._next() for _ in range(batches)]:
            self._take(run)

    def counts(self) -> DataFrame:
        """h1, h2, n over all runs; of settled hashes, the number when they were settled."""
        return self._sums(self._runs(self.levels + self.settled))

    def fresh(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """(id, pos, line): the lines of a batch whose key no run has; empty keys always stay. Only the batch is shuffled."""
        lines = docs.select(F.col(id_col).alias("id"), F.posexplode(text_lines(F.col(text_col))).alias("pos", "line"))
        key = line_key(F.col("line"))
        lines = lines.withColumn("h", line_hash(key)).withColumn("short", F.char_length(key) < self.min_chars)
        lines = lines.select("id", "pos", "line", "short", "h.h1", "h.h2")
        runs = self._runs(self.levels + self.settled).select("h1", "h2")
        short = lines.where("short").select("id", "pos", "line")
        return lines.where("not short").join(runs.hint("merge"), ["h1", "h2"], "left_anti").select("id", "pos", "line").union(short)

    def common(self, min_docs: int) -> DataFrame:
        """(h1, h2) found in at least min_docs documents; a hash may come twice."""
        if self.min_docs not in (None, min_docs):
            raise ValueError(f"these runs settle hashes at {self.min_docs} documents")
        found = self._sums(self._runs(self.levels)).where(F.col("n") >= min_docs).select("h1", "h2")
        return found.union(self._runs(self.settled).select("h1", "h2")) if any(self.settled) else found

    def close(self) -> None:
        """Forget the table's name; its files stay in the scratch folder. Results of counts() and fresh() must have been written before."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")


def drop_common(docs: DataFrame, runs: LineRuns, min_docs: int = 10, id_col: str = "doc_id", text_col: str = "text", out: tuple[str, str, str] = ("kept", "n_lines", "n_dropped")) -> DataFrame:
    """docs with the text left without common lines, the number of lines before, and of those dropped, in columns `out`."""
    clash = set(out) & set(docs.columns)
    if clash:
        raise ValueError(f"docs has columns {sorted(clash)}; name others in out")
    common = written(runs.common(min_docs), "common-lines")
    rows = common.count()
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    k1, k2, k3, k4, k5 = unused([*docs.columns, *out, "pos", "h", "h1", "h2"], "__line_id", "__line_text", "__line_hits", "__line_all", "__line_kept")
    keyed = docs.select("*", F.coalesce(F.xxhash64(F.col(f"`{id_col}`")), F.lit(0)).alias(k1), F.xxhash64(text).alias(k2))
    lines = F.transform(text_lines(F.col(f"`{text_col}`")), lambda x: line_hash(line_key(x)))
    hits = keyed.select(k1, k2, F.posexplode(lines).alias("pos", "h")).select(k1, k2, "pos", "h.h1", "h.h2")
    hits = join_small(hits, common, ["h1", "h2"], "left_semi", rows, BROADCAST_ROWS)
    # a set, so that repeated rows (one id, one text) give each position once
    hits = hits.groupBy(k1, k2).agg(F.collect_set("pos").alias(k3))
    done = keyed.join(hits, [k1, k2], "left").withColumn(k4, text_lines(F.col(f"`{text_col}`")))
    stay = F.array_except(F.sequence(F.lit(0), F.size(k4) - 1), F.col(k3))
    done = done.withColumn(k5, F.when(F.col(k3).isNotNull(), F.transform(stay, lambda i: F.get(k4, i))))
    return done.select(
        *[F.col(f"`{c}`") for c in docs.columns],
        F.when(F.col(k3).isNull(), text).otherwise(F.array_join(k5, "\n")).alias(out[0]),
        F.size(k4).cast("long").alias(out[1]),
        F.when(F.col(k3).isNull(), 0).otherwise(F.size(k4) - F.size(k5)).cast("long").alias(out[2]),
    )


def dedup(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, batches: int = 4, fanout: int = 2, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """Take all of docs into runs, batch by batch, then drop the lines common to at least min_docs documents."""
    runs = LineRuns(docs.sparkSession, fanout=fanout, min_chars=min_chars, min_docs=min_docs)
    runs.load(docs, text_col, batches)
    done = drop_common(docs, runs, min_docs, id_col, text_col, **how)
    runs.close()
    return done


def digest(docs: DataFrame) -> DataFrame:
    """The columns of the query."""
    got = dedup(docs.select("doc_id", "text"))
    return got.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))
