"""Names, keys, quota texts and fingerprints."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

# Spellings that annotation sets use for one class.
CANONICAL_NAMES = {
    "aeroplane": "airplane",
    "diningtable": "dining table",
    "motorbike": "motorcycle",
    "pottedplant": "potted plant",
    "sofa": "couch",
    "tvmonitor": "tv",
}


def canonical_name(name: Column, names: Mapping[str, str] = CANONICAL_NAMES) -> Column:
    pairs = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    return F.coalesce(F.try_element_at(pairs, F.trim(name)), F.trim(name))


def keyed(image: Column, number: Column) -> Column:
    return F.concat_ws("#", image.cast("string"), number.cast("string"))


def parse_quota(text: Column) -> Column:
    """``a:1;b:2`` as map of counts; the last colon divides, parts without a number are left out."""
    parts = F.filter(F.split(text, ";"), lambda x: F.trim(x).rlike(":\\s*[0-9]+$"))
    entry = lambda x: F.struct(F.trim(F.regexp_extract(x, "^(.*):", 1)).alias("key"), F.regexp_extract(F.trim(x), "([0-9]+)$", 1).cast("int").alias("value"))
    return F.map_from_entries(F.transform(parts, entry))


def render_quota(counts: Column) -> Column:
    """A map of counts as ``a:1;b:2``, by key."""
    entries = F.array_sort(F.map_entries(counts))
    return F.array_join(F.transform(entries, lambda e: F.concat_ws(":", e["key"], e["value"].cast("string"))), ";")


def fingerprint(keys: Column) -> Column:
    """SHA-256 of an array of strings in ascending order, a line each."""
    return F.sha2(F.array_join(F.array_sort(keys), "\n"), 256)


def ordered_hash(seed: object, *parts: Column) -> Column:
    """A hash that orders rows as a seed says, the same on every engine."""
    return F.sha2(F.concat_ws("|", F.lit(str(seed)), *[p.cast("string") for p in parts]), 256)


def alias_id(image: Column, lead: str = "9") -> Column:
    """An image id with its leading zero replaced; ids of another shape raise."""
    return F.when(image.rlike("^0[0-9]+$"), F.concat(F.lit(lead), F.substring(image, 2, 1 << 20))).otherwise(F.raise_error(F.concat(F.lit("not an image id: "), image)))


def source_id(alias: Column, lead: str = "9") -> Column:
    return F.when(alias.rlike(f"^{lead}[0-9]+$"), F.concat(F.lit("0"), F.substring(alias, 2, 1 << 20))).otherwise(F.raise_error(F.concat(F.lit("not an alias: "), alias)))
