"""kinweave: contact-network data jobs written with PySpark DataFrames."""
