"""Column expressions: geometry, plates, names and speed; all run inside the JVM."""
