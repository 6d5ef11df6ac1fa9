"""Graph helpers of the operators here."""

from ..operators.graph import EDGES, components, local_roots

__all__ = ["EDGES", "components", "local_roots"]
