"""trajframe: DataFrame -> DataFrame operators over episodes of agent steps."""

__version__ = "0.1.0"
