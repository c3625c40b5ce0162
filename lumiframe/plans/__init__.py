"""Multi-step flows: preparation, model search, experiments, scoring."""
