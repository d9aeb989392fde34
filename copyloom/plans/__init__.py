"""Planning of what to read."""
