"""Operators over documents, pages, chunks, tables, images, costs and rules: DataFrame in, DataFrame out."""
