"""Relational operators over detections, tracks and fines."""
