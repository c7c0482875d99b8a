"""Column functions: markers of the document format, and text functions that Spark lacks."""
