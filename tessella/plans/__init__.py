"""Named queries over the supplied tables, each with its SQL oracle where SQL can say it."""

from importlib import import_module
from pkgutil import iter_modules


def load() -> None:
    """Import every query module once, so that it registers its queries."""
    for m in sorted(m.name for m in iter_modules(__path__)):
        if m.startswith("q_"):
            import_module(f"{__name__}.{m}")
