"""Intermediate tables of the corpus operators, in the folder that every executor shares."""

from __future__ import annotations

from orrery.tables import drop
from orrery.tables import written as materialise

__all__ = ["drop", "materialise"]
