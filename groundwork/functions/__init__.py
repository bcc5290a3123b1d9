"""groundwork functions."""
