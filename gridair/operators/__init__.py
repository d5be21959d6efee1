"""DataFrame operators, grouped by the tables they work on."""
