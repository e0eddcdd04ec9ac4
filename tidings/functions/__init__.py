"""Column-level functions: ``Column -> Column``, evaluated inside the JVM."""
