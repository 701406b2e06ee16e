"""Tables, file formats and scratch space."""
