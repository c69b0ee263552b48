"""Column -> Column building blocks, all native expressions."""
