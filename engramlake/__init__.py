"""engramlake: a PySpark-native analytics engine for conversational and document memory."""

__version__ = "0.1.0"
