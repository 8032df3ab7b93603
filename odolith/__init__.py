"""Fleet-telemetry analytics as parameterised Spark DataFrame operators."""
