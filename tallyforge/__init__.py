"""Spark-native analytics for candidate-selection and grounding-evaluation data."""
