"""quernstone: hybrid retrieval, graph analytics and corpus preparation as Spark plans."""
