"""The evolutionary search for factor expressions."""
