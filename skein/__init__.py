"""skein: a PySpark-native engine for semantic-hypergraph retrieval over text corpora."""

__version__ = "0.1.0"
