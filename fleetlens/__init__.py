"""Code and data posture analytics as Spark DataFrame operators."""
