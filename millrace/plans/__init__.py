"""Compositions of operators: profiling, generation, rules, layers, scores."""
