"""riskfold sources."""
