"""Library audit on Spark: incremental ingest, signal features, entity resolution, linting and repair plans."""
