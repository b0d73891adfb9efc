"""Tables that the library starts from."""
