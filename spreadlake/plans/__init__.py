"""The registered queries, by section of the survey."""

import importlib
import pkgutil


def load() -> None:
    """Imports every module of this package, which registers its queries."""
    for m in pkgutil.iter_modules(__path__):
        importlib.import_module(f"{__name__}.{m.name}")
