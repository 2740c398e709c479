"""scorelake: Spark jobs over large catalogues of musical works."""
