"""A PySpark engine for property graphs of source code, hybrid search over them, and text corpora."""
