"""Column functions; everything here stays inside generated JVM code unless said."""
