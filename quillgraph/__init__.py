"""quillgraph: a PySpark analytics engine for literature graphs and hybrid retrieval."""
