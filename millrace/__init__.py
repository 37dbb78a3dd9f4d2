"""Spark-first early-warning analytics: leak-free weekly features, labels, entity resolution and read views as lazy DataFrame plans."""
