"""DataFrame -> DataFrame operators built from Spark's own aggregates,
windows, joins and writers."""
