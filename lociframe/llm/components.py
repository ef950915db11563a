"""Connected components, as the library has them."""

from lociframe.operators.graph import components

__all__ = ["components"]
