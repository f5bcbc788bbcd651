"""Spark operators for securities and fund time series, and for the text around them."""
