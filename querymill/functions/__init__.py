"""Column expressions: one text in, one value out, all inside the JVM."""
