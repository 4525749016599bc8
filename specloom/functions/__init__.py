"""Column expressions: everything here is evaluated by Spark inside the JVM."""
