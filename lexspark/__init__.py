"""Document-corpus analytics on Spark: search, retrieval, history, diff, linking, layout."""
