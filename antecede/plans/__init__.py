"""The registered queries of the library, by family."""

from antecede.plans import cleaning, evaluation, history, joins, ledger, ratings, reshape, streams  # noqa: F401
from antecede.plans.registry import ORACLES, QUERIES  # noqa: F401
