"""riskfold plans."""
