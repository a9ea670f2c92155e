"""The registered queries and their SQL, over the given tables."""
