"""affinia: entity resolution and corpus analytics on PySpark DataFrames."""
