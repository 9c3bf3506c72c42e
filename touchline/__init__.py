"""touchline: point-in-time match analytics as PySpark DataFrame plans."""
