"""Column functions: pure expressions that stay in the JVM."""
