"""Conversation-data engine on PySpark: sources, functions, operators and plans over DataFrames."""

__version__ = "0.1.0"
