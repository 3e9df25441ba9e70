"""Column-to-Column functions; every one stays inside JVM expressions."""
