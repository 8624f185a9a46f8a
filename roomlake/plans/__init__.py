"""Named queries over the standard tables, with SQL that says the same."""

from roomlake.plans import arrays, catalogue, full, metrics, mixing, profiles, reverberation, scenes, selections, signals, streams, targets
from roomlake.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "arrays", "catalogue", "full", "metrics", "mixing", "profiles", "reverberation", "scenes", "selections", "signals", "streams", "targets"]
