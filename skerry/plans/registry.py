"""All queries of the core, and their SQL."""

from skerry.plans import filters, graphs, ingestion, searching, training_data

_PARTS = (training_data, filters, searching, graphs, ingestion)
QUERIES = {name: run for part in _PARTS for name, run in part.QUERIES.items()}
SQL = {name: text for part in _PARTS for name, text in part.SQL.items()}
