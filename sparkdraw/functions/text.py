"""Text encodings of drawings: labels, and strict decoders with the place of the first bad byte."""

from __future__ import annotations

import re
from dataclasses import dataclass

BLANK = b" \t\n\f\r"

#: Labels after normalisation, by encoding.
LABELS = {
    "utf-8": ("utf8", "unicode"),
    "shift_jis": ("sjis", "shiftjis", "cp932", "windows31j", "windows932", "mskanji"),
    "hp-roman8": ("roman8", "hproman8", "r8", "cp1051", "ibm1051"),
}
_BY_LABEL = {label: name for name, labels in LABELS.items() for label in labels}
#: A double-byte character of Shift_JIS.
_PAIR = re.compile(rb"[\x81-\x9f\xe0-\xfc][\x40-\x7e\x80-\xfc]")
#: From the left as far as it goes, pairs before single bytes; the encoding standard leaves four single bytes undefined.
_SHIFT_JIS = re.compile(rb"(?:[\x00-\x7f]++|" + _PAIR.pattern + rb"|[^\xa0\xfd-\xff])*+")


def encoding_of(label: str) -> str | None:
    """The encoding that a label names, or None."""
    return _BY_LABEL.get(label.translate(str.maketrans("", "", "-_ ")).lower())


@dataclass(frozen=True)
class BadBytes(Exception):
    offset: int
    length: int


def decode(raw: bytes, encoding: str | None) -> str:
    """Strict text of raw; BadBytes tells where it fails. Without an encoding only ASCII is text."""
    if raw.isascii():
        return raw.decode("ascii")
    if encoding is None:
        raise BadBytes(0, 0)
    codec = {"utf-8": "utf-8", "shift_jis": "cp932", "hp-roman8": "hp_roman8"}[encoding]
    if encoding == "shift_jis":
        # The codec also takes the four single bytes.
        at = _SHIFT_JIS.match(raw).end()
        if at < len(raw):
            _before(raw[:at], codec)
            raise BadBytes(at, 1)
    return _before(raw, codec)


def _before(raw: bytes, codec: str) -> str:
    try:
        return raw.decode(codec)
    except UnicodeDecodeError as bad:
        raise BadBytes(bad.start, max(1, bad.end - bad.start)) from None


def decodes(raw: bytes, encoding: str) -> bool:
    try:
        decode(raw, encoding)
    except BadBytes:
        return False
    return True
