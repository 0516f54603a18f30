"""Spark-first analytics for keyed sensor series and nested snapshot feeds."""
