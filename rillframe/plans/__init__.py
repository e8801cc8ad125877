"""Query plans over the star-schema tables, one module per operator family."""

from rillframe.plans import coverage, fields, grid, kernel, registry, releases, spatial, upkeep

MODULES = (coverage, fields, grid, kernel, registry, releases, spatial, upkeep)
