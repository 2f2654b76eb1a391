"""PySpark-native engine for curating text, web pages, events, vectors and governance records."""
