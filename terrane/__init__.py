"""terrane: address registry, geocoding, map and routing analytics on PySpark."""
