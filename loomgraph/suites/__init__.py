"""Further queries by subject; importing the package registers them."""

from loomgraph.suites import files, findings, matrix, motif, names, relational, service, spectral, targets, views  # noqa: F401
