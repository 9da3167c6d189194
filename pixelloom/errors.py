"""Errors that the gates raise."""


class DataCompletenessError(ValueError):
    """A series lacks months, repeats them or has them out of order."""


class GridAlignmentError(ValueError):
    """Two grids cannot be combined."""


class RangeError(ValueError):
    """Values lie outside of what the source can hold."""
