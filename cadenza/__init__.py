"""cadenza: PySpark-native analytics for endurance-sport telemetry."""
