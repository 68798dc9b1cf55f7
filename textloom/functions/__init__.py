"""Column functions that stay in the JVM: built-in expressions only, no Python workers."""
