"""Factor libraries and the analytics on factors."""
