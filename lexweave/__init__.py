"""lexweave: learn and apply subword vocabularies over large text tables with Spark."""
