"""From firehose messages to events, claims, edges and identity changes, in batch or in a stream.

Every step is a projection of the message text, so the same functions serve a streaming DataFrame.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from claimscope.functions import claim_text as ct
from claimscope.runtime import stored

POST, REPOST = "app.bsky.feed.post", "app.bsky.feed.repost"


def messages(spark: SparkSession, path: str, per_trigger: int = 100) -> DataFrame:
    """(value): a folder of message files as a stream; what is too much for now waits, nothing is dropped."""
    return spark.readStream.option("maxFilesPerTrigger", per_trigger).text(path)


def _at(path: str) -> Column:
    return F.get_json_object("value", path)


def _held(path: str) -> Column:
    """The value of a path if it is a non-empty text that isn't null."""
    return F.when(_at(path) != "", _at(path))


def commits(raw: DataFrame, collections: tuple[str, ...] = (POST, REPOST)) -> DataFrame:
    """Canonical events of created or updated records; broken messages, removals and other collections drop out."""
    uri = F.concat(F.lit("at://"), _at("$.did"), F.lit("/"), _at("$.commit.collection"), F.lit("/"), _at("$.commit.rkey"))
    links = F.array_compact(F.array(F.coalesce(_held("$.commit.record.embed.external.uri"), _held("$.commit.record.embed.media.external.uri"))))
    as_list = lambda path: F.coalesce(F.from_json(_at(path), "array<string>"), F.array().cast("array<string>"))
    repost = _at("$.commit.collection") == REPOST
    embed = _held("$.commit.record.embed")
    return raw.where((_at("$.kind") == "commit") & _at("$.commit.operation").isin("create", "update") & _at("$.commit.collection").isin(*collections) & _at("$.did").isNotNull()).select(
        uri.alias("uri"), _at("$.commit.cid").alias("cid"), F.when(repost, "").otherwise(F.coalesce(_at("$.commit.record.text"), F.lit(""))).alias("text"),
        _at("$.did").alias("author_did"),
        F.coalesce(F.try_to_timestamp(_at("$.commit.record.createdAt")), F.timestamp_micros(_at("$.time_us").try_cast("long"))).alias("created_at"),
        _held("$.commit.record.reply.parent.uri").alias("reply_parent_uri"), _held("$.commit.record.reply.root.uri").alias("reply_root_uri"),
        as_list("$.commit.record.facets").alias("facets"), F.array_compact(F.array(embed)).alias("embeds"), links.alias("external_links"),
        F.when(repost, _held("$.commit.record.subject.uri")).alias("subject_uri"), _held("$.commit.record.embed.record.uri").alias("quoted_uri"),
        F.when(repost, "repost").otherwise("post").alias("kind"), _at("$.time_us").try_cast("long").alias("time_us"), F.col("value").alias("raw"),
    )


def identity_changes(raw: DataFrame) -> DataFrame:
    """Identity and account messages; a key that is absent differs from one that is null."""
    keys = lambda path: F.coalesce(F.json_object_keys(_at(path)), F.array().cast("array<string>"))
    identity, account = keys("$.identity"), keys("$.account")
    return raw.where(_at("$.kind").isin("identity", "account") & (_at("$.did") != "") & _at("$.time_us").try_cast("long").isNotNull()).select(
        _at("$.did").alias("did"), _at("$.kind").alias("event_kind"), _at("$.time_us").try_cast("long").alias("time_us"),
        F.coalesce(_at("$.identity.seq"), _at("$.account.seq")).try_cast("long").alias("seq"),
        F.array_contains(identity, "handle").alias("has_handle"), _at("$.identity.handle").alias("handle"),
        F.array_contains(account, "active").alias("has_active"), _at("$.account.active").try_cast("boolean").alias("active"),
    )


def claims_of(events: DataFrame, config: ct.FingerprintConfig = ct.DEFAULT) -> DataFrame:
    """Claim rows of the events that pass the complexity gate."""
    passed = events.where((F.col("kind") == "post") & ct.complex_enough(F.col("text"), F.col("external_links"), F.col("embeds"), F.col("facets")))
    return passed.select(
        F.col("author_did").alias("author"), ct.fingerprint(F.col("text"), config).alias("f"), F.col("created_at").alias("ts"), ct.assertiveness(F.col("text")).alias("confidence"),
        ct.evidence_hash(F.col("external_links"), F.col("embeds"), F.col("facets")).alias("evidence_hash"),
        ct.evidence_class(F.col("external_links"), F.col("embeds"), F.col("facets")).alias("evidence_class"), F.col("uri").alias("post_uri"), F.col("cid").alias("post_cid"),
        F.lit(config.version).alias("fingerprint_version"),
    ).select("author", F.col("f.fp").alias("fp"), F.col("f.kind").alias("fp_kind"), "ts", "confidence", "evidence_hash", "evidence_class", "post_uri", "post_cid", "fingerprint_version")


def edges_of(events: DataFrame) -> DataFrame:
    """(src_did, dst_did, type, ctime): replies, reposts and quotes of others."""
    ends = F.array(*(F.struct(F.lit(t).alias("type"), ct.did_of(F.col(c)).alias("dst")) for t, c in (("reply", "reply_parent_uri"), ("repost", "subject_uri"), ("quote", "quoted_uri"))))
    each = events.select(F.col("author_did").alias("src_did"), F.col("created_at").alias("ctime"), F.explode(F.filter(ends, lambda e: e["dst"].isNotNull())).alias("e"))
    return each.where("e.dst <> src_did").select("src_did", F.col("e.dst").alias("dst_did"), F.col("e.type").alias("type"), "ctime")


def stored_batch(folder: str, config: ct.FingerprintConfig = ct.DEFAULT):
    """A sink for a stream of messages: events, claims, edges and identity changes of a batch, each in a folder of its own.

    A batch that is run again overwrites itself, and read_ingested leaves out what was written before the batch was done: so a batch counts
    as a whole or not at all.
    """
    def write(raw: DataFrame, batch: int) -> None:
        raw = stored(raw.select("value"))
        events = commits(raw)
        parts = {"events": events, "claims": claims_of(events, config), "edges": edges_of(events), "identity": identity_changes(raw)}
        for name, df in parts.items():
            df.write.mode("overwrite").parquet(f"{folder}/{name}/batch={batch}")
        raw.sparkSession.createDataFrame([(batch,)], "batch long").write.mode("overwrite").parquet(f"{folder}/done/batch_no={batch}")

    return write


def read_ingested(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """All finished batches of events, claims, edges or identity; of events, each delivery."""
    done = spark.read.parquet(f"{folder}/done").select("batch").distinct()
    rows = spark.read.option("mergeSchema", "true").parquet(f"{folder}/{name}").withColumn("batch", F.col("batch").cast("long"))
    return rows.join(done, "batch", "left_semi")


def ingest(messages_: DataFrame, folder: str, config: ct.FingerprintConfig = ct.DEFAULT):
    """Starts the stream that writes messages into the folder as they come."""
    return messages_.writeStream.foreachBatch(stored_batch(folder, config)).option("checkpointLocation", f"{folder}/progress")


def hourly(events: DataFrame, lateness: str = "72 hours") -> DataFrame:
    """Events of each hour by a watermark over the whole stream; use late_events where each record's own lateness counts."""
    return events.withWatermark("created_at", lateness).groupBy(F.window("created_at", "1 hour"), "kind").agg(F.count("*").alias("n")).select(F.col("window.start").alias("hour"), "kind", "n")


def _days(n: int | None) -> int | None:
    return None if n is None else n * 86_400_000


def _clock(n: int | None) -> str:
    return "none" if n is None else "ProcessingTime"


class _Versions(StatefulProcessor):
    """Per uri: the hash of the last content and its time."""

    def __init__(self, ttl_ms: int | None) -> None:
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "hash string, at long", self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues):
        import pandas as pd

        # all chunks of the batch together, so that its rows are in one order
        pdf = pd.concat(list(rows), ignore_index=True).sort_values("time_us", kind="stable")
        held = self.last.get()[0] if self.last.exists() else None
        before = [held, *pdf["hash"].iloc[:-1]]
        outcome = ["inserted" if b is None else "unchanged" if b == h else "updated" for b, h in zip(before, pdf["hash"])]
        self.last.update((pdf["hash"].iloc[-1], int(pdf["time_us"].iloc[-1])))
        yield pd.DataFrame({"uri": [key[0]] * len(pdf), "outcome": outcome})

    def close(self) -> None:
        pass


def versioned(events: DataFrame, days: int | None = None) -> DataFrame:
    """(uri, outcome) of each delivery in a stream: inserted, updated or unchanged, with state by uri (RocksDB).

    With ``days``, an event that nothing was heard of for so long is forgotten, as its row is by then. That goes by the clock, so it is for
    streams that run on; one that ends when all is read keeps what it has. A batch is in order of its times.
    """
    hashed = events.select("uri", "time_us", F.sha2(F.concat_ws("\x1f", "cid", "text"), 256).alias("hash"))
    return hashed.groupBy("uri").transformWithStateInPandas(_Versions(_days(days)), "uri string, outcome string", "Append", _clock(days))


class _SecondAuthor(StatefulProcessor):
    """Per fingerprint: the last claim, and the last one by another author; no more is needed to judge the next."""

    def __init__(self, ttl_us: int, keep_ms: int | None) -> None:
        self.ttl_us, self.keep_ms = ttl_us, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "author string, at long, other_at long", self.keep_ms)

    def handleInputRows(self, key, rows, timerValues):
        import pandas as pd

        author, at, other_at = self.last.get() if self.last.exists() else (None, None, None)
        pdf, out = pd.concat(list(rows), ignore_index=True).sort_values(["at", "post_uri"], kind="stable"), []
        for a, t in zip(pdf["author"], pdf["at"].tolist()):
            if a != author:
                other_at = at
            # a claim that comes after later ones is not judged by what follows it
            out.append(other_at is not None and 0 <= t - other_at <= self.ttl_us)
            author, at = a, t
        yield pd.DataFrame({"fp": key[0], "post_uri": pdf["post_uri"], "passes": out})
        self.last.update((author, at, other_at))

    def close(self) -> None:
        pass


def gated(claims: DataFrame, ttl_seconds: int = 3600, keep_days: int | None = None) -> DataFrame:
    """(fp, post_uri, passes): whether another author has made the claim within the time before it, with state by fingerprint.

    Time is the claims' own, so a stream gives what lifecycle.second_authors gives of the same claims in order. With
    ``keep_days``, fingerprints that nothing was heard of for so long are forgotten; see versioned.
    """
    rows = claims.where("ts IS NOT NULL").select("fp", "author", F.unix_micros("ts").alias("at"), "post_uri")
    state = _SecondAuthor(ttl_seconds * 1_000_000, _days(keep_days))
    return rows.groupBy("fp").transformWithStateInPandas(state, "fp string, post_uri string, passes boolean", "Append", _clock(keep_days))
