"""wattloom: a PySpark-native engine for electricity-market data."""
