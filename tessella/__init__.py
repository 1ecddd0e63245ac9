"""Spark-native operators for detection, annotation, text-block, diagram-cell, track and log tables."""
