"""Two-dimensional vector and ratio expressions."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def dash_direction(dx: Column, dy: Column) -> Column:
    """Main direction of a dash; equal components count as vertical, (0,0) as down."""
    horizontal = F.when(dx > 0, "right").otherwise("left")
    vertical = F.when(dy > 0, "up").otherwise("down")
    return F.when(F.abs(dx) > F.abs(dy), horizontal).otherwise(vertical)


def unit_vector(direction: Column) -> Column:
    """Struct<dx float, dy float> of a direction name, (0,0) for any other text."""
    dx = F.when(direction == "left", -1).when(direction == "right", 1).otherwise(0)
    dy = F.when(direction == "up", 1).when(direction == "down", -1).otherwise(0)
    return F.struct(dx.cast("float").alias("dx"), dy.cast("float").alias("dy"))


def cosine2(px: Column, py: Column, ex: Column, ey: Column) -> Column:
    """Cosine of the angle between two vectors; null when either has no length.

    The first vector is kept in single precision, as the profile stores it.
    """
    px, py = px.cast("float"), py.cast("float")
    own = F.sqrt((px * px + py * py).cast("double"))
    other = F.sqrt(ex * ex + ey * ey)
    return F.when(
        (own > 0) & (other > 0),
        (px.cast("double") / own) * (ex / other) + (py.cast("double") / own) * (ey / other),
    )


def hp_ratio(hp: Column, max_hp: Column) -> Column:
    """Share of hit points left; null when the maximum is not positive."""
    return F.when(max_hp > 0, hp / max_hp)
