"""Streams of review events. Each run reads what is there (availableNow), with its checkpoint and sink in the shared folder."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from quirework.tables import scratch

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
ENTRY = "action string, proposed string, notes string, path string, verified boolean"
KEPT = f"uuid string, {ENTRY}, state string"


@contextmanager
def _keyed_state(spark: SparkSession):
    """Stateful processors need this store; the session's own choice comes back afterwards."""
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before)


def stream_of(spark: SparkSession, path: str) -> DataFrame:
    """A table's files as a stream."""
    schema = spark.read.parquet(path).schema
    folder, _, file = path.rpartition("/")
    one = file.endswith(".parquet") and not _is_folder(spark, path)
    return spark.readStream.schema(schema).option("pathGlobFilter", file).parquet(folder) if one else spark.readStream.schema(schema).parquet(path)


def _events(spark: SparkSession, path: str) -> DataFrame:
    return stream_of(spark, path).withColumn("ts", F.col("ts").cast("timestamp"))


def _is_folder(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()


class First(StatefulProcessor):
    """The first row of each key, by order within a batch; later batches are later."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.done = handle.getValueState("done", "seen boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        if not self.done.exists():
            first = min(rows, key=lambda r: r.event_id)
            self.done.update((True,))
            yield Row(user_id=key[0], decision=first.event_type)

    def close(self) -> None:
        pass


def first_decisions(spark: SparkSession, path: str) -> DataFrame:
    """(user_id, decision) of the first deciding event of each key. The state holds a mark for each decided key, so that a batch costs what it brings, not what came before it."""
    out = scratch(spark, "decisions")
    events = _events(spark, path).where("event_type <> 'view'").select("user_id", "event_id", "event_type")
    first = events.groupBy("user_id").transformWithState(First(), "user_id long, decision string", "append", "none")
    _run(first, out)
    return spark.read.schema("user_id long, decision string").parquet(out)


def _run(stream: DataFrame, out: str, checkpoint: str | None = None) -> None:
    with _keyed_state(stream.sparkSession):
        stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint or f"{out}-state").trigger(availableNow=True).start(out).awaitTermination()


def deduplicated(spark: SparkSession, path: str, late: str = "30 days") -> DataFrame:
    """event_id of each event once, though the stream is replayed. State of an event is dropped once the watermark, `late` behind the newest event, has passed it."""
    once = _events(spark, path).select("event_id", "ts")
    replay = once.union(_events(spark, path).select("event_id", "ts"))
    out = scratch(spark, "events")
    kept = replay.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"]).select("event_id")
    kept.writeStream.format("parquet").option("checkpointLocation", out + "-state").trigger(availableNow=True).start(out).awaitTermination()
    return spark.read.schema("event_id long").parquet(out)


class Review(StatefulProcessor):
    """One record's entry: what an earlier review says of it, until a result arrives; then the entry that it gives, once."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.entry = handle.getValueState("entry", f"{ENTRY}, done boolean")

    def handleInitialState(self, key, initialState, timerValues) -> None:
        r = initialState
        self.entry.update((r.action, r.proposed, r.notes, r.path, r.verified, False))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        prior = self.entry.get() if self.entry.exists() else None
        first = min((r for r in rows if r.wanted), key=lambda r: r.pos, default=None)
        if first is None or (prior and prior[5]):
            return
        if prior and prior[0] is not None:
            made, state = (prior[0], prior[1], prior[2], first.path, prior[4]), "kept"
        else:
            made, state = (first.action, first.proposed, prior[2] if prior else None, first.path, first.verified), "built"
        self.entry.update((*made, True))
        yield Row(uuid=first.uuid, action=made[0], proposed=made[1], notes=made[2], path=made[3], verified=made[4], state=state)

    def close(self) -> None:
        pass


def latest(prior: DataFrame) -> DataFrame:
    """Entries of an earlier review (uuid, pos and those of ENTRY), of repeated ones the last; entries without a uuid can't be found again and go."""
    fields = [f.split()[0] for f in ENTRY.split(", ")]
    return prior.where("uuid is not null").groupBy("uuid").agg(F.max_by(F.struct(*fields), "pos").alias("e")).select("uuid", "e.*")


def reviewed(results: DataFrame, prior: DataFrame, out: str, checkpoint: str) -> DataFrame:
    """The entries so far, in the table `out`, of a stream of results (uuid, pos, wanted, action, proposed, path, verified): an entry for each wanted result, as it is completed. A record
    that an earlier review decided keeps that entry at its new place; others get the new one with the earlier notes. A repeated result, in the same or a later batch, changes
    nothing. Results without a uuid are entries of their own. Runs with the same checkpoint go on where the last one stopped, or was stopped; prior is read by the first of them only."""
    key = lambda d, pos: d.withColumn("key", F.coalesce("uuid", F.concat(F.lit("\x00"), pos.cast("string"))))
    started = key(latest(prior), F.lit("")).select("key", *[f.split()[0] for f in ENTRY.split(", ")])
    entries = key(results, F.col("pos")).groupBy("key").transformWithState(Review(), KEPT, "append", "none", started.groupBy("key"))
    _run(entries, out, checkpoint)
    return results.sparkSession.read.schema(KEPT).parquet(out)


def closed(entries: DataFrame, prior: DataFrame) -> DataFrame:
    """The whole review once a run is over: its entries, and the earlier ones of records that it had no wanted result for."""
    left = latest(prior).join(entries.where("uuid is not null").select("uuid"), "uuid", "left_anti")
    return entries.unionByName(left.withColumn("state", F.lit("carried")))


def summary(review: DataFrame) -> DataFrame:
    """One row: entries, those decided before, carried over, and of the new ones those accepted, open, with another action, and verified."""
    built = F.col("state") == "built"
    return review.agg(
        F.count("*").alias("written"), F.count_if(F.col("state") == "kept").alias("kept"), F.count_if(F.col("state") == "carried").alias("carried"), F.count_if(built & (F.col("action") == "accept")).alias("accept"),
        F.count_if(built & F.col("action").isNull()).alias("open"), F.count_if(built & (F.col("action") != "accept")).alias("other"), F.count_if(built & F.col("verified")).alias("verified"),
    )
