"""riskfold functions."""
