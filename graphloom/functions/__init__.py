"""graphloom subpackage."""
