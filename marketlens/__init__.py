"""marketlens: market analytics (prices, statements, news, rates) as Spark DataFrame plans."""

__version__ = "0.1.0"
