"""The stateful frame program over streams."""
