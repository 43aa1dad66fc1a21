"""Column functions: tokens, cleaning, rendering."""
