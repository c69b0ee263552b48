"""Document, table and stream analytics as composable PySpark DataFrame functions."""
