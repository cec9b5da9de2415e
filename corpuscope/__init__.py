"""Web-corpus audit and business analytics, written as Spark DataFrame operators."""
