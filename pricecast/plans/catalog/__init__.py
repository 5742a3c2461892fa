"""The registered queries by subject; importing a module registers its queries."""

from importlib import import_module

SUBJECTS = (
    "feeds",
    "shaping",
    "storage",
    "aggregates",
    "features",
    "models",
    "metrics",
    "validation",
    "fallbacks",
    "presentation",
    "streams",
)


def load_all() -> None:
    for subject in SUBJECTS:
        import_module(f"{__name__}.{subject}")
