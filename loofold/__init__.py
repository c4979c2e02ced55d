"""loofold: leave-one-out model evaluation on tables, expressed as Spark jobs."""

__version__ = "0.1.0"
