"""Splitting texts into units whose encodings do not depend on each other.

Byte-level BPE with the usual pattern never merges across a space followed by a visible character:
such a space starts a new pre-token, and what stands before is split as if the text ended there.
So a text with single spaces and single line ends between visible characters is the concatenation
of its units, each of which a worker needs to encode once only.
"""

from __future__ import annotations

import re

#: Code points that str.split() takes as white space and tokenizers may not.
_ODD_SPACE = re.compile(r"[\x1c-\x1f\x85]")
#: White space other than spaces and line ends.
_OTHER_SPACE = "\t\r\v\f\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def spaced_units(text: str) -> list[str] | None:
    """Units of ``text``, each with its leading space; None where the text must be encoded whole."""
    if not text:
        return []
    if "  " in text or "\n\n" in text or " \n" in text or "\n " in text or "<|" in text or "\0" in text:
        return None
    if text[0].isspace() or text[-1].isspace() or any(c in text for c in _OTHER_SPACE):
        return None
    return text.replace(" ", "\0 ").replace("\n", "\0\n\0").split("\0")


def word_units(text: str) -> list[str] | None:
    """Units of ``text`` between white space; None where the text must be encoded whole."""
    if "<|" in text or _ODD_SPACE.search(text):
        return None
    return text.split()
