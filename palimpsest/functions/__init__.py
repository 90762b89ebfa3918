"""Column functions: normalisers, predicates, similarity, decisions."""
