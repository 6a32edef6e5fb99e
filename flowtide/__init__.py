"""Network-flow analytics and attack forecasting as PySpark DataFrame operators."""
