"""linematch: shopping-list text resolved against product catalogs, as Spark plans."""

__version__ = "0.1.0"
