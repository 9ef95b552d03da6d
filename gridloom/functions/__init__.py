"""Column compilers: predicates, scalar expressions and aggregates of the view language."""
