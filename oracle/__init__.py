"""SQL statements that give the expected result of each registered query."""
