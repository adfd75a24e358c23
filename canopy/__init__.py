"""Label-graph analytics and training-data operators as lazy PySpark DataFrame functions."""
