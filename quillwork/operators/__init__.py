"""DataFrame -> DataFrame operators that Spark has no single call for."""
