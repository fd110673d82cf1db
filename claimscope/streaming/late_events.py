"""Late and out-of-order events (problem 5): hourly counts by event time, put right as late records come in.

Two stateful streams, each with its state in Spark's state store:

1. Deliveries, with a watermark on their arrival. An event's first arrival is kept by event until the cut-off for its lateness
   has passed; a first arrival that is new counts +1, one that an earlier arrival replaces -1. Deliveries that arrive after
   the cut-off (``lateness`` after their event time, by their own arrival) are diverted, repeats among them too.
2. Those changes, by event-time window of an hour, fingerprint and author. Each key that a batch changes has its new totals
   emitted in update mode, and a sink upserts them.

Lateness depends on a delivery alone, so neither totals nor diverted records depend on how the stream is cut into batches. State
of an event goes once the watermark (the latest arrival less ``disorder``) is past its cut-off. What comes after that, which a feed
does only if its arrivals are out of order by more than ``disorder``, can't be told from a repeat; it is diverted as well, as ``behind``.

Keys of the state are hash buckets, so state is folded a bucket at a time, not event by event, and no key of the data is in one place
alone: the authors of an hour are spread over the buckets, and their sums are added up when the totals are read.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from claimscope.operators.timestamps import instant_micros
from claimscope.runtime import as_instant, scratch

HOUR = 3_600_000_000
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_ARRIVAL = "event_uri string, event_no long, ctime_us long, event_us long, fingerprint string, author string"
_CHANGE = f"{_ARRIVAL}, outcome string, n long"


def event_instants(posts: DataFrame) -> DataFrame:
    """(event_uri, event_us): the instant of each post's created_at, of its first stored row; null where it means none."""
    rows = posts.where("uri IS NOT NULL").select(
        F.col("uri").alias("event_uri"), "seq", instant_micros(F.col("created_at"), F.col("client_zone")).alias("event_us")
    )
    return rows.groupBy("event_uri").agg(F.min_by("event_us", "seq").alias("event_us"))


class _Bucket(StatefulProcessor):
    """State of a bucket: one table, kept as bytes, and a timer at the time when its first row can go."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.table = handle.getValueState("table", "rows binary, timer long")

    def held(self) -> tuple[pd.DataFrame | None, int]:
        if not self.table.exists():
            return None, 0
        data, timer = self.table.get()
        return pd.read_feather(io.BytesIO(data)), timer

    def hold(self, rows: pd.DataFrame, timer: int, until_us: pd.Series) -> None:
        """Keeps rows, each to a time of its own."""
        due = int(until_us.min()) // 1000 + 1 if len(rows) else 0
        if due != timer:
            if timer:
                self.handle.deleteTimer(timer)
            if due:
                self.handle.registerTimer(due)
        if not len(rows):
            return self.table.clear()
        rows.reset_index(drop=True).to_feather(to := io.BytesIO(), compression="lz4")
        self.table.update((to.getvalue(), due))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        rows, _ = self.held()
        if rows is not None:
            rows = rows[self.until(rows) >= timerValues.getCurrentWatermarkInMs() * 1000]
            self.hold(rows, 0, self.until(rows))
        return iter(())

    def close(self) -> None:
        pass


class _FirstArrivals(_Bucket):
    """By event: the first arrival. Emits counted (+1), withdrawn (-1), late and behind deliveries."""

    def __init__(self, lateness_us: int) -> None:
        self.lateness_us = lateness_us

    def until(self, rows: pd.DataFrame) -> pd.Series:
        return rows["event_us"] + self.lateness_us

    def handleInputRows(self, key, rows, timerValues):
        new = pd.concat(list(rows), ignore_index=True).drop(columns="bucket")
        late = new["ctime_us"] > self.until(new)
        if late.any():
            yield new[late].assign(outcome="late", n=0)
        new = new[~late]
        watermark = timerValues.getCurrentWatermarkInMs() * 1000
        behind = self.until(new) < watermark
        if behind.any():
            yield new[behind].assign(outcome="behind", n=0)
        new = new[~behind]
        if not len(new):
            return
        old, timer = self.held()
        both = new.assign(known=False) if old is None else pd.concat([old.assign(known=True), new.assign(known=False)], ignore_index=True)
        # the known one of equal arrivals stays
        first = both.sort_values(["ctime_us", "event_no", "known"], ascending=[True, True, False], kind="stable").drop_duplicates("event_uri")
        counted = first[~first["known"].astype(bool)].drop(columns="known")
        if len(counted):
            yield counted.assign(outcome="counted", n=1)
        if old is not None:
            withdrawn = old[old["event_uri"].isin(counted["event_uri"])]
            if len(withdrawn):
                yield withdrawn.assign(outcome="withdrawn", n=-1)
        if len(counted) or (self.until(first) < watermark).any():
            first = first[self.until(first) >= watermark].drop(columns="known")
            self.hold(first, timer, self.until(first))


class _HourTotals(_Bucket):
    """By window, fingerprint and author: the events that count. Emits the totals of the bucket's part of each changed window."""

    def __init__(self, lateness_us: int) -> None:
        self.lateness_us = lateness_us

    def until(self, rows: pd.DataFrame) -> pd.Series:
        return rows["window_us"] + HOUR + self.lateness_us

    def handleInputRows(self, key, rows, timerValues):
        new = pd.concat(list(rows), ignore_index=True).drop(columns="bucket")
        old, timer = self.held()
        both = new if old is None else pd.concat([old, new], ignore_index=True)
        both = both.groupby(["window_us", "fingerprint", "author"], dropna=False, sort=False, as_index=False)["n"].sum()
        window = ["window_us", "fingerprint"]
        changed = both.merge(new[window].drop_duplicates(), on=window)
        changed["authors"] = (changed["author"].notna() & (changed["n"] > 0)).astype("int64")
        sums = changed.groupby(window, sort=False, as_index=False)[["n", "authors"]].sum()
        yield pd.DataFrame({"window_us": sums["window_us"], "fingerprint": sums["fingerprint"], "part": key[0], "event_count": sums["n"], "unique_authors": sums["authors"]})
        both = both[(both["n"] != 0) & (self.until(both) >= timerValues.getCurrentWatermarkInMs() * 1000)]
        self.hold(both, timer, self.until(both))


def _precombined(keys: list[str], take) -> callable:
    """Rows of each Arrow batch combined by their keys before they are shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                out = take(b.to_pandas(), keys)
                yield from pa.Table.from_pandas(out, schema=b.schema, preserve_index=False).to_batches()

    return run


def _earliest(rows: pd.DataFrame, keys: list[str]) -> pd.DataFrame:
    """Of on-time deliveries the first of each event; late ones all."""
    on_time = rows[~rows["late"]].sort_values(["ctime_us", "event_no"], kind="stable").drop_duplicates(keys)
    return pd.concat([on_time, rows[rows["late"]]])


def _summed(rows: pd.DataFrame, keys: list[str]) -> pd.DataFrame:
    sums = rows.groupby(keys, dropna=False, sort=False, as_index=False).agg(n=("n", "sum"), ctime_us=("ctime_us", "max"))
    return sums[rows.columns]


class HourlyCounts:
    """State and results of one stream of deliveries (event_no, event_uri, ctime, author, claim_fingerprint).

    lateness_hours: the cut-off. disorder_days: how far arrivals may be out of order; 90 lets a backfill read its files in any
    order. buckets: of the state; more for larger feeds, fixed for the life of a folder. A new driver goes on where another stopped.
    """

    def __init__(self, spark: SparkSession, instants: DataFrame, lateness_hours: int = 72, disorder_days: int = 90, buckets: int = 256, folder: str | None = None):
        self.spark, self.instants, self.lateness = spark, instants, lateness_hours * HOUR
        self.disorder, self.buckets = f"{disorder_days} days", buckets
        self.folder = folder or scratch(spark, "late-events")

    @property
    def batches(self) -> list[int]:
        """Numbers of the batches whose totals are emitted, as the folder has them."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/updates/batch=*/_SUCCESS")
        done = path.getFileSystem(self.spark._jsc.hadoopConfiguration()).globStatus(path)
        return sorted(int(f.getPath().getParent().getName().partition("=")[2]) for f in done or [])

    def changes(self, deliveries: DataFrame) -> DataFrame:
        """The first stream: counted, withdrawn, late and behind deliveries, with the event time of their post."""
        rows = deliveries.where("event_uri IS NOT NULL AND ctime IS NOT NULL").withColumn("ctime", as_instant(F.col("ctime"), self.spark))
        rows = rows.withWatermark("ctime", self.disorder).join(self.instants.where("event_us IS NOT NULL"), "event_uri")
        rows = rows.select(
            "event_uri", F.col("event_no").cast("long").alias("event_no"), F.unix_micros("ctime").alias("ctime_us"), "event_us",
            F.col("claim_fingerprint").alias("fingerprint"), "author", (F.unix_micros("ctime") - F.col("event_us") > self.lateness).alias("late"),
        )
        rows = rows.mapInArrow(_precombined(["event_uri"], _earliest), rows.schema)
        # late deliveries meet no state, so they are spread one by one, however many an event has
        bucket = F.pmod(F.when(F.col("late"), F.xxhash64("event_no")).otherwise(F.xxhash64("event_uri")), F.lit(self.buckets)).cast("int")
        keyed = rows.select("event_uri", "event_no", "ctime_us", "event_us", "fingerprint", "author", bucket.alias("bucket"))
        return keyed.groupBy("bucket").transformWithStateInPandas(_FirstArrivals(self.lateness), _CHANGE, "Append", "EventTime")

    def windows(self, changes: DataFrame) -> DataFrame:
        """The second stream: new totals of each part of each window that changed."""
        rows = changes.where("outcome IN ('counted', 'withdrawn') AND fingerprint IS NOT NULL").withColumn("ctime", F.timestamp_micros("ctime_us"))
        rows = rows.withWatermark("ctime", self.disorder).withColumn("window", F.window(F.timestamp_micros("event_us"), "1 hour"))
        rows = rows.select(F.unix_micros("window.start").alias("window_us"), "fingerprint", "author", "n", F.unix_micros("ctime").alias("ctime_us"))
        rows = rows.mapInArrow(_precombined(["window_us", "fingerprint", "author"], _summed), rows.schema).drop("ctime_us")
        keyed = rows.withColumn("bucket", F.pmod(F.xxhash64("window_us", "fingerprint", "author"), F.lit(self.buckets)).cast("int"))
        kinds = "window_us long, fingerprint string, part int, event_count long, unique_authors long"
        return keyed.groupBy("bucket").transformWithStateInPandas(_HourTotals(self.lateness), kinds, "Update", "EventTime")

    def run(self, source: str, files_per_batch: int | None = None) -> "HourlyCounts":
        """Reads all that is available of a Parquet feed as a stream, and returns when it is processed."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(source)
        single = path.getFileSystem(self.spark._jsc.hadoopConfiguration()).getFileStatus(path).isFile()

        def feed(at: str, schema) -> DataFrame:
            stream = self.spark.readStream.schema(schema)
            if files_per_batch:
                stream = stream.option("maxFilesPerTrigger", files_per_batch)
            return stream.parquet(at)

        provider = "spark.sql.streaming.stateStore.providerClass"
        before = self.spark.conf.get(provider, None)
        self.spark.conf.set(provider, _ROCKS)
        try:
            deliveries = feed(f"{source[:-1]}[{source[-1]}]" if single else source, self.spark.read.parquet(source).schema)  # a stream takes one file only as a pattern
            first = self.changes(deliveries).writeStream.format("parquet").option("path", f"{self.folder}/changes")
            self._drain(first.outputMode("append"), "arrivals")
            changes = self.spark.readStream.schema(_CHANGE).parquet(f"{self.folder}/changes")
            self._drain(self.windows(changes).writeStream.foreachBatch(self._upsert).outputMode("update"), "totals")
        finally:
            self.spark.conf.set(provider, before) if before else self.spark.conf.unset(provider)
        return self

    def _drain(self, writer, name: str) -> None:
        writer.option("checkpointLocation", f"{self.folder}/progress/{name}").trigger(availableNow=True).start().awaitTermination()

    def _upsert(self, totals: DataFrame, batch: int) -> None:
        """A batch has a folder of its own, so a batch that is run again overwrites itself; the last batch of a key holds."""
        totals.write.mode("overwrite").parquet(f"{self.folder}/updates/batch={batch}")

    def current(self) -> DataFrame:
        """(fingerprint, hour_epoch, event_count, unique_authors): the last totals of each key, without those back at 0."""
        done = self.batches
        if not done:
            return self.spark.createDataFrame([], "fingerprint string, hour_epoch long, event_count long, unique_authors long")
        parts = self.spark.read.parquet(f"{self.folder}/updates").where(F.col("batch") <= done[-1])
        if len(done) > 1:  # of one batch, each key has one row
            parts = parts.groupBy("window_us", "fingerprint", "part").agg(F.max_by(F.struct("event_count", "unique_authors"), "batch").alias("u")).select("window_us", "fingerprint", "u.*")
        sums = parts.groupBy("fingerprint", (F.col("window_us") / 1_000_000).cast("long").alias("hour_epoch"))
        return sums.agg(F.sum("event_count").alias("event_count"), F.sum("unique_authors").alias("unique_authors")).where("event_count > 0")

    def late(self) -> DataFrame:
        """The diverted deliveries: (event_uri, event_no, ctime_us, event_us, fingerprint, author, outcome, late_us)."""
        rows = self.spark.read.schema(_CHANGE).parquet(f"{self.folder}/changes").where("outcome IN ('late', 'behind')")
        return rows.drop("n").withColumn("late_us", F.col("ctime_us") - F.col("event_us") - self.lateness)


def differences(right: DataFrame, published: DataFrame) -> DataFrame:
    """(fingerprint, hour_epoch) whose published row has other values, is missing, or should not exist."""
    key = ["fingerprint", "hour_epoch"]
    p = published.select(*key, F.struct("event_count", "unique_authors").alias("published"))
    r = right.select(*key, F.struct(F.col("event_count"), F.col("unique_authors")).alias("right"))
    return r.join(p, key, "full").where(~F.col("right").eqNullSafe(F.col("published"))).select(*key)
