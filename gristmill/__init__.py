"""Clean, combine, profile and analyze tables of any size with Spark."""

from gristmill.naming import is_id_name, nested_to_text
from gristmill.operators.order import with_row_order
from gristmill.operators.store import clear_kept_tables
from gristmill.plans.analyze import analyze
from gristmill.plans.clean import clean
from gristmill.plans.gather import gather
from gristmill.plans.profile import profile
from gristmill.sources.csv import read_csv
from gristmill.sources.tables import (
    discover,
    read_json,
    read_parquet,
    read_table,
    read_tables,
    write_clean,
    write_gather,
    write_table,
)

__all__ = [
    "analyze",
    "clean",
    "clear_kept_tables",
    "discover",
    "gather",
    "is_id_name",
    "nested_to_text",
    "profile",
    "read_csv",
    "read_json",
    "read_parquet",
    "read_table",
    "read_tables",
    "with_row_order",
    "write_clean",
    "write_gather",
    "write_table",
]
