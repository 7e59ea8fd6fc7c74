"""Match free-text product lines to a reference catalog, as Spark jobs."""
