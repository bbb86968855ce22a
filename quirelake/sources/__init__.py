"""Readers of the tables and of the nested payloads."""

from quirelake.sources.tables import block_texts, read_table, schema_of  # noqa: F401
