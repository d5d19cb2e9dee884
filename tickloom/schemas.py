"""Explicit schemas and the fixed column sets of the data model; nothing is inferred on read."""

from pyspark.sql import types as T

# Names that stored tables, logs and models rely on.
OHLCV = ["open", "high", "low", "close", "volume"]
MACRO_SERIES = {"SP500": "SP500_Return", "VIX": "VIX_Return", "EURUSD": "EURUSD_Return"}
INDEX_SYMBOL = "^GSPC"
TARGET = "Target_Log_Return"
FEATURES = [
    "SP500_Return", "VIX_Return", "EURUSD_Return", "Sentiment_Score", "Log_Return",
    "Lag_1", "Lag_2", "Lag_3", "Lag_5", "Rolling_Std_14",
    "Distancia_SMA_20", "Distancia_SMA_50", "Bollinger_Width", "Volume_Shock",
    "Month_Sin", "Month_Cos", "Day_Sin", "Day_Cos", "Volume_ROC_5", "OBV_ROC_5",
    "RSI_14", "MACD_Line", "MACD_Signal", "MACD_Histogram", "ATR_14", "ATR_Pct",
]
# End of fixed values.


def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in fields])


BARS = _struct(
    ("symbol", T.StringType()), ("date", T.DateType()), ("open", T.DoubleType()), ("high", T.DoubleType()),
    ("low", T.DoubleType()), ("close", T.DoubleType()), ("volume", T.LongType()),
)
MACRO_LONG = _struct(("date", T.DateType()), ("series", T.StringType()), ("close", T.DoubleType()))
LABEL_SCORES = T.ArrayType(_struct(("label", T.StringType()), ("score", T.DoubleType())))
NEWS = _struct(
    ("symbol", T.StringType()), ("published", T.LongType()), ("headline", T.StringType()), ("scores", LABEL_SCORES)
)
SENTIMENT = _struct(("symbol", T.StringType()), ("date", T.DateType()), ("sentiment_score", T.DoubleType()))
FEATURE_TABLE = _struct(
    ("symbol", T.StringType()), ("date", T.DateType()), *[(c, T.DoubleType()) for c in FEATURES], (TARGET, T.DoubleType())
)
PREDICTION = _struct(
    ("symbol", T.StringType()), ("current_price", T.DoubleType()), ("predicted_price_tomorrow", T.DoubleType()),
    ("variation_pct", T.DoubleType()), ("timestamp", T.StringType()), ("message", T.StringType()),
)
PREDICTION_LOG = _struct(
    ("symbol", T.StringType()), ("timestamp", T.StringType()), ("model_version", T.StringType()),
    ("features_input", T.MapType(T.StringType(), T.DoubleType())), ("prediction_output", PREDICTION),
)
TRIALS = _struct(
    ("symbol", T.StringType()), ("trial_id", T.LongType()), ("model_type", T.StringType()),
    ("params", T.MapType(T.StringType(), T.StringType())), ("rmse", T.DoubleType()), ("mae", T.DoubleType()),
)
