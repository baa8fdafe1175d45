"""corpusloom: corpus curation, pair mining and retrieval evaluation as Spark DataFrame plans."""

__version__ = "0.1.0"
