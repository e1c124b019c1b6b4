"""Registered queries and their SQL."""

from . import neighbourhoods, spectra, trajectories  # noqa: F401
from .inputs import ORACLE, QUERIES  # noqa: F401
