"""Pure Column functions (no UDFs): casts, labels, bands, geo, numerics."""
