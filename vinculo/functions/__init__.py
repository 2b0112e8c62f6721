"""Column helpers and job helpers shared by the operators."""
