"""Structured Streaming adapter.

The reference has no streaming code (no watermark, window or state), so no
stateful operator is built. The stateless operators here — scalar functions,
feature engineering, encoding, clipping, fitted scalers applied as literals —
are plain projections and run unchanged on a streaming DataFrame; this
module wires one of them between a file source and a file sink with a
reliable checkpoint location.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def stream_transform(spark: SparkSession, source_dir: str, schema, transform: Callable[[DataFrame], DataFrame],
                     sink_dir: str, name: str = "cohort_stream", fmt: str = "parquet",
                     max_files_per_trigger: int | None = None, available_now: bool = True,
                     checkpoint: str | None = None):
    """readStream(source) -> transform -> writeStream(sink).

    ``checkpoint`` names the stream's own checkpoint folder; without it the
    folder beside the sink, ``<sink_dir>.checkpoint``, is used. It does not
    depend on the session, so a restarted job resumes where it stopped and
    writes nothing twice. Returns the started ``StreamingQuery``.
    """
    reader = spark.readStream.schema(schema).format(fmt)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    src = reader.load(source_dir)
    out = transform(src)
    ckpt = checkpoint or f"{sink_dir.rstrip('/')}.checkpoint"
    w = out.writeStream.format(fmt).option("checkpointLocation", ckpt).option("path", sink_dir).outputMode("append")
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.queryName(name).start()
