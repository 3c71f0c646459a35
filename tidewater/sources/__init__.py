"""Files that tables are read from and written to."""
