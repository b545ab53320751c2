"""Loading and saving tables and rules."""
