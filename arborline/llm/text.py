"""Words of a text, whatever was done to its layout, markup, case, punctuation or character forms."""

from __future__ import annotations

import html
import re
import unicodedata

# Letters of other scripts that look like Latin ones.
LOOKALIKES = str.maketrans("аеорсухіјѕһԁԛԝАВЕКМНОРСТХІЈЅαον", "aeopcyxijshdqwabekmhopctxijsaov")

_UNSEEN = re.compile("[\u00ad\u034f\u061c\u115f\u1160\u17b4\u17b5\u180b-\u180e\u200b-\u200f\u202a-\u202e\u2060-\u206f\ufe00-\ufe0f\ufeff]")
_TAG = re.compile(r"</?[A-Za-z][^<>]{0,200}>|<!--.*?-->", re.S)
_LINK = re.compile(r"\]\((?:https?:|/|#|\./)[^)\s]*\)")
_BROKEN = re.compile(r"[-‐‑¬](?<=[^\W\d_].)\s*\n\s*(?=[^\W\d_])")
_DAMAGED = re.compile("â€[\u0080-¿™œ“”˜¦¢\"]?")
_APART = re.compile(r"[^\w\s.,'’\-‐‑]|_")
_MARKS = re.compile(r"[\u0300-\u036f\u1ab0-\u1aff\u1dc0-\u1dff\u20d0-\u20ff\ufe20-\ufe2f]+")
_INSIDE = re.compile(r"[^\w\s]+")


def plain(text: str) -> str:
    """The text in canonical characters, without markup, invisible characters and line-end hyphens; case is kept."""
    if "&" in text:
        text = html.unescape(text)
    if not text.isascii():
        text = _UNSEEN.sub("", _DAMAGED.sub(" ", text))
        text = unicodedata.normalize("NFKC", text)
    if "<" in text:
        text = _TAG.sub(" ", text)
    if "](" in text:
        text = _LINK.sub("]", text)
    return _BROKEN.sub("", text) if "\n" in text else text


def fold(text: str) -> str:
    """Lower case without accents, look-alike letters as Latin ones."""
    if text.isascii():
        return text.lower()
    text = unicodedata.normalize("NFKD", text.casefold().translate(LOOKALIKES))
    return _MARKS.sub("", text)


def words(text: str | None) -> list[str]:
    """The words of a text: runs between blanks, without case, accents, markup and punctuation (also that within a word)."""
    if not text:
        return []
    return _INSIDE.sub("", _APART.sub(" ", fold(plain(text)))).split()
