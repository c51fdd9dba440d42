"""Spark-native analytics of traffic violations: detections in, tracks, violations and fines out."""
