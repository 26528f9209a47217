"""scribelake: a PySpark-native engine for transcript libraries and the audio signals behind them."""
