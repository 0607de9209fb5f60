"""Sources: the shared test tables and the landing readers for feed files."""
