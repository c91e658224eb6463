"""All registered queries."""

from touchline.plans import calibration, evaluation, functions, goals, live, models, provenance, quality, ratings, streams, text  # noqa: F401
from touchline.plans.registry import ORACLES, QUERIES  # noqa: F401
