"""Table and file readers and writers."""
