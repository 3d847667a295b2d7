"""The registered queries over the driver tables."""

from . import designs, fits, people, registry, rounds  # noqa: F401
