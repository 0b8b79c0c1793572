"""Plan patterns shared by operators, and the query catalogue."""
