"""corvine: retrieval, grounding, evaluation and corpus preparation as Spark plans."""
