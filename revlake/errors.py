"""Failures that a comparison can end with; in tables they appear as error codes."""


class RevisionError(Exception):
    """Base of expected failures."""

    code = "error"


class InvalidDocument(RevisionError):
    """The input is not an acceptable document."""

    code = "invalid"


class RasterDocument(InvalidDocument):
    """A page has images but no usable structured content."""

    code = "raster"


class RegistrationError(RevisionError):
    """Two populated pages cannot be registered reliably."""

    code = "alignment"


class Cancelled(RevisionError):
    """The caller stopped the comparison between stages."""

    code = "cancelled"
