"""Candle analytics on Spark: series repair, volatility, liquidity, pump detection, diagnostics, streaming."""
