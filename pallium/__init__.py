"""PII detection, pseudonymisation and evaluation as Spark DataFrame operators."""
