"""Evidence-first scoring of large document collections on Spark."""
