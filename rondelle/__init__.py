"""Analytics over long conversations, and their evaluation, on PySpark DataFrames."""
