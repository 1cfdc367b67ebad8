"""Column expressions: each takes and returns ``pyspark.sql.Column``."""
