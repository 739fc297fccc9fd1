"""sparkloom: data quality, text, similarity and model analytics as Spark plans."""

__version__ = "0.1.0"
