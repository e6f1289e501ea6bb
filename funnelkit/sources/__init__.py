"""Table readers (A1), the role schemas of the mart's inputs, and the adapters that
derive each role from the TPC-H-style fixture tables."""

from funnelkit.sources.tables import FIXTURE_TABLES, read_table, read_source

__all__ = ["FIXTURE_TABLES", "read_table", "read_source"]
