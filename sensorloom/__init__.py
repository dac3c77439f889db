"""Process-monitoring analytics for wide sensor tables, as Spark DataFrame operators."""
