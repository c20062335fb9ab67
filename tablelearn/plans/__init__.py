"""Plans: the registered queries (Spark) and their SQL oracles."""
