"""groundwork operators."""
