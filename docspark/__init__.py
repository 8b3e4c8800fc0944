"""docspark: DataFrame operators for large document collections."""
