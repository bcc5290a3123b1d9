"""groundwork plans."""
