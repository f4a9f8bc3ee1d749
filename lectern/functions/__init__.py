"""Column functions on text and on years; all run inside the JVM."""
