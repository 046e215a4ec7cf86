"""Resource limits of a read."""

from __future__ import annotations

from dataclasses import dataclass, fields

MIB, GIB = 1 << 20, 1 << 30


@dataclass(frozen=True)
class Limits:
    """Upper bounds; each must be a positive integer. A drawing beyond one fails on its own."""

    max_file_size: int = GIB
    max_lines: int = 10_000_000
    max_sections: int = 100_000
    max_records: int = 5_000_000
    max_line_length: int = 16 * MIB
    max_record_size: int = 256 * MIB
    max_decompressed_size: int = GIB
    max_compression_ratio: int = 1000

    def __post_init__(self):
        for f in fields(self):
            value = getattr(self, f.name)
            if isinstance(value, bool) or not isinstance(value, int):
                raise TypeError(f"{f.name} must be an integer")
            if value < 1:
                raise ValueError(f"{f.name} must be positive")
