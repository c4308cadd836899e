"""Time-series panels on Spark: efficiency, behaviour, regimes, backtests and their inference."""
