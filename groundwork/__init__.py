"""groundwork: Spark table and stream jobs for evidence-grounded document work."""
