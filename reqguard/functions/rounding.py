from pyspark.sql import Column
from pyspark.sql import functions as F


def round_half_up(x: Column, digits: int) -> Column:
    """Round by ``floor(x * 10^d + 0.5) / 10^d``, the same on every engine for the same double."""
    scale = float(10 ** digits)
    return F.floor(x.cast("double") * scale + 0.5).cast("double") / scale
