"""Assertions about individuals as values."""

from __future__ import annotations

import re

from turnstile.functions import formula

#: What assertions about individuals look like.
ROLE, CONCEPT = re.compile(r"^(\w+)\((\w+)\s*,\s*(\w+)\)$"), re.compile(r"^(\w+)\((\w+)\)$")


def assertion(text: str) -> tuple[str, ...] | None:
    """(pred, individual) or (role, from, to); None for what is neither."""
    try:
        s = formula.parse(text)
    except formula.Malformed:
        return None
    m = s[0] == "atom" and (ROLE.match(s[1]) or CONCEPT.match(s[1]))
    return m.groups() if m else None


def concept(name: str, individual: str) -> str:
    return f"{name}({individual})"


def role(name: str, subject: str, object_: str) -> str:
    return f"{name}({subject},{object_})"


def onto_kind(text: str) -> str:
    """'concept', 'role' or a connective's name; Malformed for a bare atom."""
    s = formula.parse(text)
    if s[0] != "atom":
        return s[0]
    a = assertion(s[1])
    if a is None:
        raise formula.Malformed(f"Not a concept or role assertion: {text!r}")
    return "concept" if len(a) == 2 else "role"


def all_onto_atomic(texts) -> bool:
    """Whether every text is a concept or role assertion; a text that cannot be read is none."""
    return all(assertion(t) is not None for t in texts)
