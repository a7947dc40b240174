"""riskfold operators."""
