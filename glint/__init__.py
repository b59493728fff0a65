"""Event-camera analytics on Spark DataFrames.

An event stream is a DataFrame (seq, t, x, y, p): position, seconds, pixel column, pixel
row and polarity. Images are relations (channel, y, x, value) with the hit pixels only.
"""

__version__ = "0.1.0"


def version() -> str:
    return __version__
