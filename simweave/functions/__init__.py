"""Column functions: text, hashes, bits and scores. All of them stay in the JVM."""
