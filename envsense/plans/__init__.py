"""Named queries over the generated tables, and the same in SQL."""
