"""quillon: typed knowledge-graph and retrieval analytics as Spark plans."""
