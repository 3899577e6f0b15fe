"""Registered queries by area; ``load`` imports them all and returns the registry."""


def load():
    from palimpsest.plans import blocks, lint, output, registry, revisions, saved, structure, text, trees  # noqa: F401
    return registry
