"""Jobs composed from the operators, and the views over the driver tables."""
