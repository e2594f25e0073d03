"""Named queries over the tables of a folder, and SQL that gives the same rows."""
