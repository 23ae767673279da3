"""DataFrame operators: ingestion, filters, joins, rollups, top-k and table updates."""
