"""Feature expressions, the same for training rows and for requests."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from rentlens import vocab
from rentlens.functions.numeric import safe_ratio, within


def room_features(size: Column, bedrooms: Column, bathrooms: Column) -> dict[str, Column]:
    """Features of size and room counts."""
    total = bedrooms + bathrooms
    rooms = within(total, lo=1.0)
    area = within(size, lo=1.0)
    per_room = size / rooms
    return {
        "size_sqm_sq": size * size,
        "log_size_sqm": F.log1p(size),
        "bath_per_bed": safe_ratio(bathrooms, bedrooms, otherwise=bathrooms),
        "total_rooms": total,
        "size_per_room": per_room,
        "room_density": rooms / area,
        "size_room_balance": F.log1p(per_room),
        "bedroom_share": bedrooms / rooms,
        "bathroom_share": bathrooms / rooms,
        "room_value_proxy": F.sqrt(area) * (bedrooms * 0.60 + bathrooms * 0.55 + 1.0),
        "bed_bath_interaction": bedrooms * bathrooms,
    }


def type_flags(kind: Column, names: Sequence[str] = tuple(vocab.MODEL_TYPES)) -> dict[str, Column]:
    """One 0/1 column per known type."""
    return {f"type_{t}": F.coalesce(kind == t, F.lit(False)).cast("double") for t in names}
