"""Analytics over routing and text tables, built from Spark DataFrame functions."""
