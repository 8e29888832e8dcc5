"""How modules of queries register them."""

from __future__ import annotations

from collections.abc import Callable


def registry() -> tuple[dict, dict, Callable]:
    """Queries by name, their SQL by name, and the decorator that adds to both."""
    queries: dict = {}
    texts: dict[str, str] = {}

    def query(text: str | None = None) -> Callable:
        def add(f: Callable) -> Callable:
            queries[f.__name__] = f
            if text:
                texts[f.__name__] = text
            return f

        return add

    return queries, texts, query
