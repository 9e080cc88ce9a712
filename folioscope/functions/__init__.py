"""Column functions and the fixed values they rest on."""
