"""Column builders: no joins, no shuffles, all JVM-side expressions."""
