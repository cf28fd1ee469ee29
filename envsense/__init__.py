"""envsense: a PySpark-native engine for multi-sensor anomaly detection."""

__version__ = "0.1.0"
