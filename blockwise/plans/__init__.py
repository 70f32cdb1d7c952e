"""Domain jobs composed from the operators (each returns a DataFrame)."""
