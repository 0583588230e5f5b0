"""Entity-level feature tables from relational history data, as Spark plans."""
