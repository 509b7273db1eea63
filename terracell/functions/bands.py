"""Per-cell arithmetic on image bands, elevations, scores and labels."""

from pyspark.sql import functions as F

# Scene-classification codes that count as clear sky.
CLEAR_CLASSES = (2, 4, 5, 6, 7, 11)
EPSILON = 1e-9


def clear_mask(scl):
    """1 where the scene class is clear, else 0 (a missing class is not clear)."""
    return F.when(scl.isin(*CLEAR_CLASSES), F.lit(1)).otherwise(F.lit(0))


def ndwi(green, nir):
    return (green - nir) / (green + nir + F.lit(EPSILON))


def ndvi(nir, red):
    return (nir - red) / (nir + red + F.lit(EPSILON))


def unit_scale(v):
    """uint8 range to [-1, 1]."""
    return F.lit(2.0) * v / F.lit(255.0) - F.lit(1.0)


def fraction(v):
    return v / F.lit(255.0)


def uint8(v):
    """Truncating cast; the caller guarantees 0..255."""
    return F.floor(v).cast("int")


def z_score(v, mean, std):
    """Standard score; a zero spread counts as one."""
    return (v - mean) / F.when(std == 0, F.lit(1.0)).otherwise(std)


def logistic_stretch(z):
    """255/(1+exp(-0.6 z)) truncated; a missing score gives 0."""
    return F.coalesce(F.floor(F.lit(255.0) / (F.lit(1.0) + F.exp(F.lit(-0.6) * z))), F.lit(0)).cast("int")


def binarise(score, threshold=0.5):
    """1 at or above the threshold, 0 below, missing stays missing."""
    return F.when(score >= threshold, F.lit(1)).when(score < threshold, F.lit(0))


def null_if_nodata(v, nodata):
    return F.when(v != F.lit(nodata), v)


def default_nodata(v, is_float):
    """Missing marker by storage type: NaN for floats, 0 for integers."""
    return F.when(~F.isnan(v), v) if is_float else F.when(v != 0, v)


def null_if_huge(v, limit=1e30):
    return F.when(v < F.lit(limit), v)


def valid_elevation(v):
    """Elevation, or missing when at or below -999999 or at or above 10000."""
    return F.when((v > -999999) & (v < 10000), v)


def has_image(*bands):
    """A cell has image data when its bands do not sum to zero."""
    total = F.coalesce(bands[0], F.lit(0))
    for b in bands[1:]:
        total = total + F.coalesce(b, F.lit(0))
    return total > 0


def zero_fill(v):
    return F.coalesce(v, F.lit(0))


def outside_inside(inside):
    """1 outside, 0 inside; what is missing or not above zero is outside."""
    return F.when(inside > 0, F.lit(0)).otherwise(F.lit(1))


def recode(v, mapping):
    """Replace mapped values, keep the others. ``mapping`` is a small literal dictionary."""
    if not mapping:
        return v.cast("double")
    pairs = [F.lit(x) for k, value in mapping.items() for x in (int(k), float(value))]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), v.cast("int")), v.cast("double"))


def loss_weight(v):
    """Weight of a recoded label: 0 becomes 1, fractions become 0, the rest is kept."""
    return F.when(v == 0, F.lit(1.0)).when(v < 1, F.lit(0.0)).otherwise(v)


def loss_target(v):
    """Target of a recoded label: below 1 is 0, the rest is 1."""
    return F.when(v < 1, F.lit(0)).when(v > 0, F.lit(1))


def blend_weight(r, c, height, width):
    """Mosaic weight 1/(1+d) with a 10-norm distance from the centre, scaled so its maximum is 1.

    The largest weight sits on the middle cell (odd side) or half a cell off it (even side), so the
    scale is a closed form of the shape and needs no pass over the raster.
    """
    mid = lambda size: (size - 1) / F.lit(2.0)
    off = lambda i, size: F.when(size > 1, F.abs(F.try_divide(i.cast("double"), mid(size)) - 1)).otherwise(F.lit(0.0))
    nearest = lambda size: F.when(
        (size % 2 == 0) & (size > 1), F.try_divide(F.lit(1.0), (size - 1).cast("double"))
    ).otherwise(F.lit(0.0))
    norm = lambda a, b: F.pow(F.pow(a, F.lit(10.0)) + F.pow(b, F.lit(10.0)), F.lit(0.1))
    return (norm(nearest(height), nearest(width)) + 1) / (norm(off(r, height), off(c, width)) + 1)


INDEX_FUNCTIONS = {
    "ndwi": lambda b: ndwi(b["b03"], b["b08"]),
    "ndvi": lambda b: ndvi(b["b08"], b["b04"]),
}


def register_index(name, fn):
    """Add an index computer: a function from a dict of band columns to a column."""
    INDEX_FUNCTIONS[name] = fn


def compute_indices(df, names, bands=("b08", "b04", "b03", "b02"), scale=fraction):
    """Append the named indices, computed on bands scaled to [0, 1]."""
    scaled = {b: scale(F.col(b)) for b in bands}
    return df.withColumns({name: INDEX_FUNCTIONS[name](scaled) for name in names})
