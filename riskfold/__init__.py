"""riskfold: leakage-safe tabular risk modelling as Spark DataFrame jobs.

Every operator is a function from DataFrame(s) to a DataFrame.  Fitted
state (medians, modes, encodings, fences, selector decisions, trees) lives in
small DataFrames keyed by a *fit group* ``g``: ``g = 0..k-1`` is "trained on
every development row whose fold is not g", ``g = -1`` is "trained on all
development rows" (the hold-out refit).  Fitting all groups is one aggregate
job over the fold-expanded rows; map-side partial aggregation keeps the
shuffle proportional to the statistics, not to the rows.
"""

from riskfold.config import Cohort, Settings  # noqa: F401
from riskfold.session import build_session, materialize  # noqa: F401
