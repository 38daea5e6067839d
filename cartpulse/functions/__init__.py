"""Column-expression building blocks: calendar bounds, array HOF expressions, scoring curves."""
