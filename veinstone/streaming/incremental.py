"""Structured Streaming forms: new files into fragments, usage over event time, cumulative usage by key.

File sources only see additions; removals need a full listing, which plans.ingest.build makes.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState

from ..functions import identity
from ..functions.structure import Chunking
from ..operators import chunking
from ..sources import files

FILE = "path string, modificationTime timestamp, length long, content binary"


def file_stream(spark: SparkSession, folder: str, glob: str = "*.{txt,md,markdown,text}") -> DataFrame:
    """New files of a folder as rows."""
    return spark.readStream.format("binaryFile").schema(FILE).option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(folder)


def stream_fragments(stream: DataFrame, out: str, checkpoint: str, cfg: Chunking = Chunking()) -> StreamingQuery:
    """Each micro-batch's files as fragments, appended under its batch id: a batch that runs again replaces itself."""

    def write(batch: DataFrame, batch_id: int) -> None:
        parsed = files.parsed(batch.select(F.col("path").alias("rel_path"), "content"))
        digest = files.content_hash(F.col("content"))
        docs = parsed.where("parsed.error IS NULL").select(identity.source_key(F.lit(None).cast("string"), digest).alias("source_key"), digest.alias("document_hash"), F.col("parsed.pages").alias("pages"))
        chunking.fragments(docs, cfg).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_usage(events: DataFrame, width: str = "1 day", late: str = "2 days") -> DataFrame:
    """Events and their sum of value by type and window of event time; what is later than the watermark is left out."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("events"), F.round(F.sum("value"), 6).alias("value")).select(F.col("window.start").alias("start"), "event_type", "events", "value")


def cumulative_usage(events: DataFrame) -> DataFrame:
    """user_id, events, value: each user's totals so far, after every batch that has the user."""

    def update(key: tuple, parts: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        count, total = state.get if state.exists else (0, 0.0)
        for part in parts:
            count, total = count + len(part), total + float(part["value"].sum())
        state.update((count, total))
        yield pd.DataFrame({"user_id": [key[0]], "events": [count], "value": [total]})

    schema = "user_id long, events long, value double"
    return events.groupBy("user_id").applyInPandasWithState(update, schema, "events long, value double", "update", "NoTimeout")
