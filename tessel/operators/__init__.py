"""DataFrame -> DataFrame operators of the corpus pipeline."""
