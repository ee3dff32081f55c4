"""A PySpark-native engine for segmenting, translating and curating document collections."""
