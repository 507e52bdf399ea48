"""PySpark jobs for wrist-actigraphy and sleep analysis."""
