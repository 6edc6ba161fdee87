"""The power log as a stream: file source, watermark, tumbling means, and a stateful hole detector."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tallyloom.operators.grid import iso_instant

LOG_SCHEMA = "iso_ts string, watts double, device string, tag string"


def power_stream(spark: SparkSession, folder: str, kind: str = "parquet", files_per_trigger: int = 1, pattern: str | None = None) -> DataFrame:
    """(device, tag, at, watts) of usable readings as files arrive."""
    reader = spark.readStream.format(kind).schema(LOG_SCHEMA).option("maxFilesPerTrigger", files_per_trigger)
    reader = reader.option("pathGlobFilter", pattern) if pattern else reader
    at = iso_instant(F.col("iso_ts"))
    return reader.load(folder).select("device", "tag", at.alias("at"), "watts").where("at is not null and watts is not null and not isnan(watts) and watts >= 0 and watts < double('Infinity')")


def minute_windows(readings: DataFrame, late: str = "10 minutes", width: str = "1 minute") -> DataFrame:
    """Mean, peak and count per device, tag and window; a window closes once the watermark has passed it."""
    grouped = readings.withWatermark("at", late).groupBy("device", "tag", F.window("at", width))
    return grouped.agg(F.count("*").alias("n"), F.avg("watts").alias("mean_w"), F.max("watts").alias("peak_w")).select("device", "tag", F.col("window.start").alias("start_at"), "n", "mean_w", "peak_w")


def holes(readings: DataFrame, max_gap_s: float = 15.0, late: str = "10 minutes") -> DataFrame:
    """Stretches longer than max_gap_s between consecutive readings of a device and tag, as the stream shows them.

    The state of a source is the newest moment seen; readings older than it close no hole.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        out = []
        stamps = sorted(x for pdf in frames for x in (pdf["at"].astype("datetime64[us]").astype("int64") / 1e6).tolist())
        for at in stamps:
            if last is not None and at - last > max_gap_s:
                out.append((key[0], key[1], last, at))
            last = at if last is None else max(last, at)
        state.update((last,))
        yield pd.DataFrame(out, columns=["device", "tag", "from_s", "to_s"])

    return readings.withWatermark("at", late).groupBy("device", "tag").applyInPandasWithState(
        step, "device string, tag string, from_s double, to_s double", "last double", "append", GroupStateTimeout.NoTimeout
    )


def run_once(stream: DataFrame, name: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Drives a stream through all files there are and returns what it wrote, as a table in memory."""
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.table(name)


def run_to_files(stream: DataFrame, target: str, checkpoint: str) -> None:
    """The append-only sink: new rows as parquet files, exactly once per checkpoint."""
    stream.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()
