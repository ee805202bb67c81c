"""History requests and their plans."""
