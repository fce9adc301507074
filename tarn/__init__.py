"""tarn: Spark-native discovery, extraction and hybrid search over web-document corpora."""

__version__ = "0.1.0"
