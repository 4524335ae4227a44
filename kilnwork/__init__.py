"""kilnwork: Spark jobs that curate, split and score text and code corpora."""
