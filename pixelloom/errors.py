"""Errors are data: every codec function returns a value or one of these codes with a reason."""

from __future__ import annotations

UNKNOWN_FORMAT = "unknownFormat"
INVALID_DATA = "invalidData"
UNSUPPORTED = "unsupportedFeature"
INVALID_DIMENSIONS = "invalidDimensions"
OUT_OF_BOUNDS = "regionOutOfBounds"


class ImageError(Exception):
    def __init__(self, code: str, reason: str = ""):
        super().__init__(f"{code}: {reason}")
        self.code, self.reason = code, reason


def invalid(reason: str) -> ImageError:
    return ImageError(INVALID_DATA, reason)


def unsupported(reason: str) -> ImageError:
    return ImageError(UNSUPPORTED, reason)
