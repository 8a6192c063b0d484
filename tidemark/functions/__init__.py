"""Part of the candle engine."""
