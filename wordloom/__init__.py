"""wordloom: a Spark engine over knowledge pages, session logs and delivery queues."""

__version__ = "0.1.0"
