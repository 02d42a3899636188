"""Parameters and the field and group specifications."""
