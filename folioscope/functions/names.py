"""Names for columns that an operator adds for itself."""

from __future__ import annotations

from collections.abc import Callable, Iterable


def free_names(taken: Iterable[str]) -> Callable[[str], str]:
    """Gives names that no column has, in any spelling, and none twice."""
    held = {c.lower() for c in taken}

    def free(name: str) -> str:
        while name.lower() in held:
            name += "_"
        held.add(name.lower())
        return name

    return free
