"""corpusloom: a Spark engine for document corpora, typed graphs and retrieval evaluation."""
