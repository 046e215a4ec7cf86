"""Errors that a drawing, or the options of a read, can cause."""


class DrawingError(ValueError):
    """A drawing cannot be read."""


class InvalidDrawing(DrawingError):
    """Neither drawing text nor a known envelope, or a broken envelope."""


class UnsupportedDrawing(DrawingError):
    """A known envelope that is not decoded."""


class LimitExceeded(DrawingError):
    """A resource limit was reached."""


CLASSES = {c.__name__: c for c in (DrawingError, InvalidDrawing, UnsupportedDrawing, LimitExceeded)}
