"""Time functions as column expressions."""
