from cohortspark.sources.readers import (
    read_table, read_csv, read_any, resolve_target, schema_frame, shape_frame, load_cohort, load_source,
)
from cohortspark.sources.sinks import has_flag, write_flagged, write_table

__all__ = ["read_table", "read_csv", "read_any", "resolve_target", "schema_frame",
           "shape_frame", "load_cohort", "load_source", "has_flag", "write_flagged", "write_table"]
