"""Closed forms on the WGS84 ellipsoid and the Web Mercator tile scheme."""

import math

from pyspark.sql import functions as F

# WGS84 semi-major axis and flattening.
A = 6378137.0
FLATTENING = 1 / 298.257223563
E2 = FLATTENING * (2 - FLATTENING)


def degrees_north(metres, lat):
    """Degrees of latitude covered by a distance along the meridian."""
    s = F.sin(F.radians(lat))
    m = F.lit(A * (1 - E2)) / F.pow(1 - F.lit(E2) * s * s, F.lit(1.5))
    return F.degrees(F.lit(float(metres)) / m)


def degrees_east(metres, lat):
    """Degrees of longitude covered by a distance along the parallel."""
    phi = F.radians(lat)
    s = F.sin(phi)
    n = F.lit(A) / F.sqrt(1 - F.lit(E2) * s * s)
    return F.degrees(F.lit(float(metres)) / (n * F.cos(phi)))


def tile_latitude(y, zoom):
    """Latitude of the upper edge of tile row ``y``."""
    scale = F.pow(F.lit(2.0), zoom)
    return F.degrees(F.atan(F.sinh(F.lit(math.pi) * (1 - 2 * y / scale))))


def tile_bounds(x, y, zoom):
    """Struct w,s,e,n of an XYZ tile."""
    scale = F.pow(F.lit(2.0), zoom)
    lon = lambda i: i / scale * 360.0 - 180.0
    return F.struct(
        lon(x).alias("w"), tile_latitude(y + 1, zoom).alias("s"), lon(x + 1).alias("e"), tile_latitude(y, zoom).alias("n")
    )


def tile_index(lon, lat, zoom):
    """Struct x,y of the tile holding a point."""
    scale = F.pow(F.lit(2.0), zoom)
    phi = F.radians(lat)
    fy = (1 - F.log(F.tan(phi) + 1 / F.cos(phi)) / math.pi) / 2
    clip = lambda v: F.least(F.greatest(F.floor(v * scale), F.lit(0)), (scale - 1).cast("long"))
    return F.struct(clip((lon + 180.0) / 360.0).cast("int").alias("x"), clip(fy).cast("int").alias("y"))


def web_mercator_to_lonlat(x, y):
    """EPSG:3857 metres to degrees."""
    return F.struct(
        F.degrees(x / F.lit(A)).alias("lon"), F.degrees(F.atan(F.sinh(y / F.lit(A)))).alias("lat")
    )


def bounds_to_lonlat(w, s, e, n, epsg):
    """Bounds in degrees; only EPSG:4326 (unchanged) and EPSG:3857 are known."""
    low, high = web_mercator_to_lonlat(w, s), web_mercator_to_lonlat(e, n)
    pick = lambda plain, projected: F.when(epsg == 4326, plain).when(epsg == 3857, projected)
    return F.struct(
        pick(w, low["lon"]).alias("w"), pick(s, low["lat"]).alias("s"),
        pick(e, high["lon"]).alias("e"), pick(n, high["lat"]).alias("n"),
    )
