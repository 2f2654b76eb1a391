"""Names for added columns that don't clash with a table's own."""

from __future__ import annotations

from collections.abc import Iterable


def free(name: str, taken: Iterable[str]) -> str:
    """The name, with as many underscores behind it as make it differ from those taken (case ignored)."""
    held = {x.lower() for x in taken}
    while name.lower() in held:
        name += "_"
    return name
