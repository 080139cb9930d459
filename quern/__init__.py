"""quern: event-log, follow-graph and account-scoring analytics as Spark plans."""

__version__ = "0.1.0"
