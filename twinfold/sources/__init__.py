from .records import (  # noqa: F401
    NA_VALUES, Roles, as_text, column_roles, fill_missing, read_records, validate, with_rid,
)
from .sinks import write_artifacts, write_pairs_csv  # noqa: F401
