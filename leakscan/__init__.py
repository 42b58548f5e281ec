"""A PySpark-native engine that finds leaked credentials in text, trees, diffs and histories."""
