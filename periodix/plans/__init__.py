"""Named-result registry and the registered query catalog with SQL oracles."""
