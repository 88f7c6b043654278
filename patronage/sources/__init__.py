from patronage.sources.readers import (
    nan_to_null, parse_dates, read_customers, read_products, read_table, read_transactions)
from patronage.sources.writers import write_csv, write_parquet

__all__ = ["nan_to_null", "parse_dates", "read_customers", "read_products", "read_table",
           "read_transactions", "write_csv", "write_parquet"]
