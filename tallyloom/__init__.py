"""tallyloom: Spark-first analytics over large corpora of social-media posts."""

__version__ = "0.1.0"
