"""Column functions and small DataFrame helpers used by the operators."""

from . import arrays, bands, dates, geo, quantiles, strings, units, wind  # noqa: F401
