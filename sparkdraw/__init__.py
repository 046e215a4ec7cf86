"""sparkdraw: a PySpark engine for corpora of line-oriented 2D drawings."""

from importlib import import_module

__version__ = "0.1.0"
#: Public names and the modules that have them; loaded on first use, so that workers import only what they run.
_HOME = {
    "Corpus": ".corpus", "read": ".corpus", "DrawingError": ".errors", "InvalidDrawing": ".errors", "LimitExceeded": ".errors", "UnsupportedDrawing": ".errors",
    "detect_format": ".sources.files", "Limits": ".sources.limits", "read_stream": ".streaming.ingest", "register": ".sources.reader",
}
__all__ = sorted(_HOME)


def __getattr__(name: str):
    if name in _HOME:
        return getattr(import_module(_HOME[name], __name__), name)
    raise AttributeError(f"module {__name__!r} has no attribute {name!r}")
