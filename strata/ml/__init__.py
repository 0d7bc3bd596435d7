"""Models: features, folds, out-of-fold scores, a registry, inference."""
