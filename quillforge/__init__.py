"""quillforge: document trees, chunking and layout geometry as Spark DataFrames."""

__version__ = "0.1.0"
