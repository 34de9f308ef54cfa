"""Named queries over the driver's tables."""

from tessera.plans import registry, texts, projects, stores, tasks  # noqa: F401
