"""Incremental ingest of listings and scoring of request streams."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from rentlens.operators.context import MarketContext
from rentlens.operators.scoring import Predictor, attach_market, respond, score_requests
from rentlens.plans.cleaning import parse_listings
from rentlens.session import releasing, stage


STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ON_DISK = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def new_rows(stream: DataFrame, keys: Sequence[str], time: str | None = None, delay: str | None = None) -> DataFrame:
    """Rows whose keys were not seen before; rows without a key (null) count as one key.

    Without ``delay`` keys are kept for good, however late a copy comes: the state store holds them, each
    batch asks only for its own keys, and state grows by one entry a key. With ``delay`` state is dropped once
    the watermark on ``time`` passes, so a key that comes back later than that is let in again.
    """
    if delay is None:
        return stream.dropDuplicates(list(keys))
    timed = stream.withColumn(time, F.col(time).cast("timestamp"))
    return timed.withWatermark(time, delay).dropDuplicatesWithinWatermark(list(keys))


def ingest_listings(stream: DataFrame, key: str = "source_url", time: str = "fetched_at", delay: str | None = None) -> DataFrame:
    """New raw listings, parsed. Only row-local cleaning runs on the stream: medians and quantiles need
    the whole table and stay in the batch plan."""
    return parse_listings(new_rows(stream, [key], time, delay))


def write_table(stream: DataFrame, path: str, checkpoint: str, once: bool = True, state_store: str = ON_DISK) -> StreamingQuery:
    """Append a stream to a parquet table; with ``once`` what is there is processed and the query ends.

    State lives in ``state_store``, by default on the executors' disks with its changes in the checkpoint, so
    it is not bound by memory. A checkpoint keeps the store it was started with.
    """
    writer = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    conf = stream.sparkSession.conf
    before = conf.get(STATE_STORE)
    conf.set(STATE_STORE, state_store)
    try:  # a query takes its settings when it starts
        return (writer.trigger(availableNow=True) if once else writer).outputMode("append").start()
    finally:
        conf.set(STATE_STORE, before)


def score_stream(
    requests: DataFrame, predict: Predictor, ctx: MarketContext, path: str, checkpoint: str, model_name: str = "model",
    once: bool = True, **market,
) -> StreamingQuery:
    """Score request batches against a frozen context and model.

    Each batch overwrites its own folder, so a batch that is run again after a failure does not
    duplicate rows. What a batch stages is deleted when it is done.
    """

    def score_batch(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        with releasing(spark):
            # read once: places are matched in one pass over the batch and joined back in another
            rows = score_requests(attach_market(stage(batch, "batch"), ctx, **market), predict, ctx)
            respond(rows, ctx, model_name).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    writer = requests.writeStream.foreachBatch(score_batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
