"""Words and signs of a pattern."""

from __future__ import annotations

import re
from typing import NamedTuple

#: Signs of more than one character, and what some of them are read as.
COMPOUNDS = (
    "<...=", "<...<", "<...*", "*...=", "*...<", "*...*", "...=", "...<", "...*", "<...", "*...", "...", "<:+:", "<<<", ">>>", "&&&", "|||", "^^^", "~~~", "<|>", ">>=", "<*>", "<$>", ">>",
    "<*", "*>", "<+:", "<:+", "<+", "++", "::", "//", "#[", ":=", "==", "&&", "||", "^^", "->", "=>", "<=", ">=", "!=", "⁻¹'", "⁻¹", "''", "×ˢ", "∃!",
)
READ_AS = {"->": "→", "<=": "≤", ">=": "≥", "forall": "∀", "exists": "∃", "λ": "fun", "↦": "=>"}

_PART = r"(?:«[^»]*»|(?!λ)[^\W\d](?:\w|')*(?:[!?](?!=))*'*)"
_TOKEN = re.compile(
    rf"""(?P<space>\s+)|(?P<string>"(?:\\.|[^"\\])*")|(?P<sign>{"|".join(map(re.escape, COMPOUNDS))})|(?P<char>'(?:\\[^']*.?|[^'\\])')
    |(?P<number>0x[0-9a-fA-F]+|\d+\.\d+(?:[eE][+-]?\d+)?|\d+[eE][+-]?\d+|\d+)|(?P<word>\.?{_PART}(?:\.(?:{_PART}|\d+))*|\.\d+)|(?P<close>⟫(?:_\w+)?)|(?P<other>.)""",
    re.X | re.S,
)


class Token(NamedTuple):
    kind: str
    text: str
    glued: bool  # nothing between it and what is before it

    def is_(self, *texts: str) -> bool:
        return self.kind not in ("string", "char", "number") and self.text in texts


def tokens(pattern: str) -> list[Token]:
    out, glued = [], False
    for m in _TOKEN.finditer(pattern):
        kind, text = m.lastgroup, m[0]
        if kind == "space":
            glued = False
            continue
        if kind != "string" and kind != "char":
            text = READ_AS.get(text, text)
        out.append(Token(kind, text, glued))
        glued = True
    return out
