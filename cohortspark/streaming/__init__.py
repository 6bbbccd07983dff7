from cohortspark.streaming.stream import stream_transform  # noqa: F401
