"""All registered queries of the library and their SQL twins."""

from __future__ import annotations

from caliperlake.plans import balloons, decisions, frames, inspection, journal, layout, profiles, projections, records, releases, requirements, review, routing, titleblocks, visuals, workbench
from caliperlake.plans.register import ORACLES, QUERIES

PLANS = (balloons, decisions, frames, inspection, journal, layout, profiles, projections, records, releases, requirements, review, routing, titleblocks, visuals, workbench)
__all__ = ["ORACLES", "PLANS", "QUERIES"]
