"""pulsegrid: a PySpark-native analytics engine for patient vital-sign data."""
