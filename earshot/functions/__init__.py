"""Column functions: string, array and struct expressions evaluated in the JVM."""
