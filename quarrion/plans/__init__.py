"""The registered queries, by family, with their SQL."""
