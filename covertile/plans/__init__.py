"""Plans: the whole analysis, and the registered queries."""
