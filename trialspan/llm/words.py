"""Words of a text as they compare: without case, accents, markup, look-alikes and invisible characters."""

from __future__ import annotations

import re
import sys
import unicodedata

# Letters of other scripts that look like Latin ones.
LOOK_ALIKES = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "ё": "e", "һ": "h", "і": "i", "ї": "i", "ј": "j", "к": "k", "ӏ": "l", "м": "m",
    "н": "h", "о": "o", "р": "p", "ԛ": "q", "ѕ": "s", "т": "t", "у": "y", "ѵ": "v", "ԝ": "w", "х": "x",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "γ": "y",
    "ı": "i", "ɑ": "a", "ɡ": "g", "ß": "ss", "æ": "ae", "œ": "oe", "ø": "o", "ł": "l", "đ": "d",
}

_FOLD: dict[int, str | None] = {}
for _c in range(sys.maxunicode + 1):
    _kind = unicodedata.category(chr(_c))
    if _kind in ("Mn", "Me", "Cf"):
        _FOLD[_c] = None
for _a, _b in LOOK_ALIKES.items():
    _FOLD[ord(_a)] = _b

#: tags and character references
_TAG = re.compile(r"</?[A-Za-z][^<>\n]{0,80}>|&(?:#\d{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z]{2,8});")
_WIDE = r"぀-ヿ㐀-䶿一-鿿豈-﫿"
_WORD = re.compile(rf"[{_WIDE}]|[^\W_{_WIDE}]+")
_BEYOND = re.compile(r"[^\x00-\x7f]+")
_ASCII_WORD = re.compile(r"[a-z0-9]+")


def words_of(text: str) -> list[str]:
    """The words of ``text`` in order; characters of scripts without blanks count as words each."""
    if "<" in text or "&" in text:
        text = _TAG.sub(lambda m: "" if m.group() in ("&shy;", "&zwj;", "&zwnj;") or m.group()[0] == "<" else " ", text)
    if text.isascii():
        return _ASCII_WORD.findall(text.lower())
    return _WORD.findall(_BEYOND.sub(lambda m: m.group().translate(_FOLD), unicodedata.normalize("NFKD", text).lower()))
