"""The queries that the engine registers, with the SQL they are checked against."""
