"""srcloom: code-corpus analytics as Spark DataFrame jobs."""
