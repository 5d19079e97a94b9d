"""Search backends in order of preference; requests themselves stay outside."""

from __future__ import annotations

from collections.abc import Callable, Sequence


def search(query: str, backends: Sequence[tuple[str, Callable[[str], list[dict]]]]) -> tuple[list[dict], str]:
    """The rows of the first backend that answers with any, and its name; ``none`` if none does. A backend that fails is
    passed over."""
    for name, ask in backends:
        try:
            rows = ask(query)
        except OSError:
            continue
        if rows:
            return rows, name
    return [], "none"
