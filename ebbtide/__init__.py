"""Customer drift analytics on PySpark: features, text signals, training sets, scoring and work queues."""

__version__ = "0.1.0"
