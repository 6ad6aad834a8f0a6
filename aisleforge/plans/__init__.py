"""Named queries over the pipeline's tables."""

from . import assortment, audit, pictures, portfolio, stores, texts  # noqa: F401
from .registry import ORACLES, QUERIES  # noqa: F401
