"""The query-string grammar: words, field:word, -word, and phrases in double quotes."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass
class Parsed:
    """(field or None, word) pairs, and (field or None, words) for phrases."""

    terms: list[tuple[str | None, str]] = field(default_factory=list)
    phrases: list[tuple[str | None, list[str]]] = field(default_factory=list)
    excluded: list[tuple[str | None, str]] = field(default_factory=list)


def parse_query(text: str) -> Parsed:
    """A quote without its partner ends the query."""
    out, pieces = Parsed(), text.split('"')
    if len(pieces) % 2 == 0:
        pieces.pop()
    for i, piece in enumerate(pieces):
        if i % 2 == 0:
            for raw in piece.split():
                word = raw.lstrip("-")
                name, colon, rest = word.partition(":")
                (out.excluded if raw.startswith("-") else out.terms).append((name, rest) if colon else (None, word))
        else:
            name, colon, rest = piece.partition(":")
            named = bool(colon) and all(c.isalnum() or c == "_" for c in name)
            if words := (rest if named else piece).split():
                out.phrases.append((name if named else None, words))
    return out
