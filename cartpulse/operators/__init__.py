"""DataFrame operators: pair features, items, ranking, evaluation, model, diagnostics."""
