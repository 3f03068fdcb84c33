"""varve: tiered event warehouse, fact log, column semantics and ledgers on Spark."""
