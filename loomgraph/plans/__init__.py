"""Plan helpers: lineage cuts and fix-point loops."""

from loomgraph.plans.scratch import Scratch, fixpoint

__all__ = ["Scratch", "fixpoint"]
