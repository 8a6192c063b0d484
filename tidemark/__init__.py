"""tidemark: a Spark-native engine for OHLCV candle analytics and corpus preparation."""
