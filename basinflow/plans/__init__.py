"""Named queries over the tables, with the SQL that an independent engine can check them by."""
