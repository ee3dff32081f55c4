"""Column functions over text, JVM-side, and their pure-Python counterparts for parsers."""
