"""groundwork streaming."""
