"""Document analytics on Spark: files and text become ordered typed elements, which are cleaned,
classified, joined, stitched and staged with DataFrame operations."""

__version__ = "0.1.0"
