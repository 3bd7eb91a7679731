"""moodmill: polarity analytics for short messages, as Spark DataFrame jobs."""

__version__ = "0.1.0"
