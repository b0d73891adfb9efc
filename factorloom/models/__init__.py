"""Return models and their evaluation."""
