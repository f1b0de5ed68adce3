"""Column builders. Everything here stays inside Catalyst expressions."""
