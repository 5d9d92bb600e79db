"""margin_engine: Spark-native cleaning, catalogue matching, margin and
reporting for shop order-line exports."""

__version__ = "0.1.0"
