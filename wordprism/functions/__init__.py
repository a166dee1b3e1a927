"""Column functions: text predicates, cleaning, vectors, geometry, hashing."""
