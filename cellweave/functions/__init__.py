"""cellweave subpackage."""
