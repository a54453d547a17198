"""Pre-token pattern of byte-level tokenizers, matched as their libraries do.

The tokenizer libraries carry the character classes of Unicode 16, the
``regex`` module newer ones.  Texts with a character whose class differs are
matched with a pattern that takes those characters out of ``\\p{L}`` and
``\\p{N}``; all other texts use the pattern as it is.
"""

from __future__ import annotations

import regex

#: Fixed value: the published pattern.
BYTE_LEVEL = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Letters and numbers that Unicode 16 does not have (first-last, hexadecimal).
AFTER_UNICODE_16 = """
558 58b-58c 88f c5c cdc 208f 209d-209f a7ce-a7cf a7d2 a7d4 a7dd a7e2 a7f1 ab6c-ab6d 107bb-107bf 10940-10959
10ec5-10ec7 10ed9-10eee 11b0a 11db0-11ddb 11de0-11de9 11df1 1246f 12475-1247f 12550-12686 16ea0-16eb8 16ebb-16ed3
16ff2-16ff6 187f8-187ff 18cd6-18cda 18d09-18d20 18d80-18df2 18e00-19191 191a0-191d2 1b123-1b128 1b168 1d6a6
1df1f-1df24 1df2b-1df81 1df90-1df96 1dfcd-1dfff 1e6c0-1e6de 1e6e0-1e6e2 1e6e4-1e6e5 1e6e7-1e6ed 1e6f0-1e6f4
1e6fe-1e6ff 2b73a-2b73f 2b81e 2cea2-2cead 323b0-33479 3d000-3fc3f
"""


def _newer() -> str:
    spans = (part.partition("-")[::2] for part in AFTER_UNICODE_16.split())
    return "[" + "".join(rf"\U{int(a, 16):08x}-\U{int(b or a, 16):08x}" for a, b in spans) + "]"


class Pieces:
    """``findall`` / ``finditer`` of a pattern under Unicode 16 classes."""

    def __init__(self, pattern: str = BYTE_LEVEL):
        newer = _newer()
        self.plain = regex.compile(pattern)
        self.newer = regex.compile(newer)
        older = pattern.replace(r"\p{L}", rf"[\p{{L}}--{newer}]").replace(r"\p{N}", rf"[\p{{N}}--{newer}]")
        self.older = regex.compile("(?V1)" + older)

    def pattern_for(self, text: str):
        return self.plain if text.isascii() or not self.newer.search(text) else self.older

    def of(self, text: str):
        """All pre-tokens; lazily for very long texts."""
        found = self.pattern_for(text)
        if len(text) < 1 << 20:
            return found.findall(text)
        return (m.group() for m in found.finditer(text))
