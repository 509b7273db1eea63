"""Feature classes of hydrography descriptions."""

from pyspark.sql import functions as F

# Descriptions containing one of these are ignored.
IGNORED_TYPES = (
    "Ice Mass", "Bridge", "Tunnel", "Underground Conduit", "Submerged Stream", "Levee", "Nonearthen Shore",
    "Rapids", "Dam/Weir", "Gate", "Pipeline",
)

# The first text contained in the description gives the class (its place in this list).
CLASS_TEXTS = (
    "Playa",
    "Inundation",
    "Swamp/Marsh: Hydrographic Category = Intermittent",
    "Swamp/Marsh: Hydrographic Category = Perennial",
    "Swamp",
    "Reservoir",
    "Lake/Pond: Hydrographic Category = Intermittent",
    "Lake/Pond: Hydrographic Category = Perennial",
    "Lake/Pond",
    "Spillway",
    "Drainageway",
    "Wash",
    "Canal Ditch: Canal Ditch Type = Stormwater",
    "Canal/Ditch: Canal/Ditch Type = Aqueduct",
    "Canal",
    "Artificial Path",
    "Stream/River: Hydrographic Category = Ephemeral",
    "Stream/River: Hydrographic Category = Intermittent",
    "Stream/River: Hydrographic Category = Perennial",
    "Stream/River",
)

# Training weight of each class.
CLASS_WEIGHTS = {
    1: 0.0, 2: 0.0, 3: 0.5, 4: 0.5, 5: 0.5, 6: 2.0, 7: 0.5, 8: 7.0, 9: 7.0, 10: 0.0, 11: 0.5, 12: 0.5, 13: 0.5,
    14: 1.0, 15: 0.5, 16: 1.0, 17: 7.5, 18: 7.5, 19: 6.5, 20: 6.5, 21: 1.0,
}

JUNCTION_CLASS = 22


def is_kept_type(description, ignored=IGNORED_TYPES):
    keep = F.lit(True)
    for text in ignored:
        keep = keep & ~F.contains(description, F.lit(text))
    return keep


def is_stream_line(geom_type, description):
    return geom_type.isin("LineString", "MultiLineString") & (
        F.contains(description, F.lit("Stream")) | F.contains(description, F.lit("Artificial"))
    )


def feature_class(description, texts=CLASS_TEXTS):
    """1-based place of the first text found, ignoring case; one past the end if none is."""
    lowered = F.lower(description)
    out = F.lit(len(texts) + 1)
    for place in range(len(texts), 0, -1):
        out = F.when(F.contains(lowered, F.lit(texts[place - 1].lower())), F.lit(place)).otherwise(out)
    return out
