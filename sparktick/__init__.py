"""Spark-native library for trade-count bars, causal bar features, signals and walk-forward backtests."""
