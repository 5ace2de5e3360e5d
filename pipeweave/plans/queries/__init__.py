"""Query modules; importing this package registers all of them."""

from . import admission, checks, edits, formulas, ingest, lookups, more, planning, polygons, results, spatial, texts, trees, validation  # noqa: F401
