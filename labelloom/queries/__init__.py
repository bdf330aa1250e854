"""All queries of the library; importing this package registers them."""

from labelloom.queries import cycles, extras, graphs, labels, learning, qa, relational, samples, scans, scalars, sets, streams, vectors, windows  # noqa: F401
from labelloom.registry import COVERS, ORACLES, QUERIES

FLAGSHIP = "label_calculator"
__all__ = ["COVERS", "FLAGSHIP", "ORACLES", "QUERIES"]
