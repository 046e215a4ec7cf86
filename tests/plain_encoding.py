"""The choice of an encoding by plain calls, for comparison."""

import re

from sparkdraw.functions.text import _PAIR, decodes, encoding_of


def version_is_utf8(version: str) -> bool:
    """3.20 and later, each part read as a number; 3.4 is earlier."""
    parts = version.strip().split(".")
    digits = [int(p) if re.fullmatch(r"\+?[0-9]+", p) else None for p in parts[:2]]
    return digits[0] is not None and (digits[0], (digits[1] if len(digits) > 1 else 0) or 0) >= (3, 20)


def detect(override: str | None, bom: bool, version: str | None, declared: str | None, candidates: list[bytes]) -> tuple[str | None, str, str | None]:
    """(encoding, source, diagnostic): override, mark, version, declaration, then the texts themselves.

    The diagnostic is a code without a place, or None.
    """
    said = encoding_of(declared) if declared is not None else None
    for source, name in (("override", override), ("utf8_bom", "utf-8" if bom else None), ("mi_version", "utf-8" if version is not None and version_is_utf8(version) else None)):
        if name is not None:
            return name, source, "MI_ENCODING_CONFLICT" if said is not None and said != name else None
    if declared is not None:
        return said, "declared", None if said else "MI_UNSUPPORTED_DECLARED_ENCODING"
    odd = [c for c in candidates if not c.isascii()]
    if not odd:
        return None, "ascii_only", None
    if all(decodes(c, "utf-8") for c in odd):
        return "utf-8", "heuristic", "MI_ENCODING_GUESSED"
    if all(decodes(c, "shift_jis") for c in odd) and any(_PAIR.search(c) for c in odd):
        return "shift_jis", "heuristic", "MI_ENCODING_GUESSED"
    return None, "undetermined", "MI_ENCODING_UNDETERMINED"
