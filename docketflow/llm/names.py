"""Names that operators give to their own columns."""

from __future__ import annotations


def refuse(columns: list[str], *names: str) -> None:
    """An error if one of ``names``, which an operator gives to its own columns, is taken."""
    taken = {c.lower() for c in columns} & {n.lower() for n in names}
    if taken:
        raise ValueError(f"the input already has {sorted(taken)}")
