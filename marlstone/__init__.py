"""marlstone: document search, analytics and data preparation declared as Spark plans."""

__version__ = "0.1.0"
