"""Sparse matrices and tiles as Spark relations: products, formats, scans, graphs."""
