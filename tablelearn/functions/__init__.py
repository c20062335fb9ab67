"""Column functions and distributed helpers shared by the operators."""
