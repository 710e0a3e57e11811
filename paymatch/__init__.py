"""paymatch — payment-processor reconciliation on Spark DataFrames."""

from paymatch.audit import Audit
from paymatch.params import ReconParams, fixture_params

__all__ = ["Audit", "ReconParams", "fixture_params"]
