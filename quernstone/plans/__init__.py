"""Driver-side planning: query language, filters, query plans."""
