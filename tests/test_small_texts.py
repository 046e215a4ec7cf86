"""Shortcuts for small drawings and for Shift_JIS agree with what they stand for."""

import random
import re

import numpy as np
import pytest

from sparkdraw.functions import text as codecs
from sparkdraw.sources import scan

PAIR = re.compile(rb"[\x81-\x9f\xe0-\xfc][\x40-\x7e\x80-\xfc]")


def walked(raw):
    """The first single byte that Shift_JIS leaves undefined, byte by byte."""
    at = 0
    while at < len(raw):
        if PAIR.match(raw, at):
            at += 2
        elif raw[at] in (0xA0, 0xFD, 0xFE, 0xFF):
            return at
        else:
            at += 1
    return len(raw)


def test_shift_jis_walk():
    pick = random.Random(5)
    for _ in range(20_000):
        raw = bytes(pick.choice(b"a@\x7f\x80\x81\xa0\xa1\xe0\xfc\xfd\xff") for _ in range(pick.randrange(9)))
        assert codecs._SHIFT_JIS.match(raw).end() == walked(raw)
    # No bound on length: a walk that recursed would fail here.
    long = b"\x82\xa0x" * 1_000_000
    assert codecs.decode(long, "shift_jis") == "あx" * 1_000_000
    with pytest.raises(codecs.BadBytes) as bad:
        codecs.decode(long + b"\xff" + long, "shift_jis")
    assert (bad.value.offset, bad.value.length) == (len(long), 1)


def test_few_lines(monkeypatch):
    pick = random.Random(6)
    cases = [b"", b"\n", b"a", b"\n\n", *[bytes(pick.choice(b"ab\n") for _ in range(pick.randrange(12))) for _ in range(3000)]]
    few = [scan._lines_of(x) for x in cases]
    monkeypatch.setattr(scan, "SMALL", 0)
    for x, found in zip(cases, few, strict=True):
        assert all(np.array_equal(a, b) for a, b in zip(found, scan._lines_of(x), strict=True)), x
