"""Census and survey analytics as Spark DataFrame operators."""
