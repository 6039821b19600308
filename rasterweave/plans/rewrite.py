"""Choices made while a plan is built; Catalyst does the rest."""

from __future__ import annotations

from rasterweave.functions.catalog import Filter

#: Rows that a scattered plan may make before bands are cheaper (taps x pixels, before combining).
SCATTER_LIMIT = 20_000_000


def choose_engine(kernel: Filter, height: int | None, width: int | None) -> str:
    """Identity is removed by the caller; small known rasters scatter, all else is tiled. All engines give the same pixels."""
    if height is None or width is None:
        return "tile"
    taps = kernel.size**2 if kernel.taps is None else len(kernel.nonzero())
    return "relational" if taps * height * width <= SCATTER_LIMIT and taps <= 25 else "tile"


def rewrites(kernel: Filter) -> list[str]:
    """Names of the rewrites that hold for a filter."""
    if kernel.taps is None:
        return ["wrap_halo"]
    found = []
    if kernel.is_identity():
        found.append("identity")
    if len(kernel.nonzero()) < kernel.taps.size:
        found.append("zero_taps")
    if kernel.separated() is not None:
        found.append("separable")
    if (kernel.taps == kernel.taps[::-1]).all():
        found.append("folded_rows")
    return found
