"""All named queries: importing the plan modules registers them."""

from . import corpus, evidence, extras, matches, observations, projection, sources, streams, traffic  # noqa: F401
from .registry import ORACLES, QUERIES  # noqa: F401
