"""Snapshots of an entity store put together in the order in which they are loaded.

Entities with a key are replaced by later ones; lists are unions by key, each item at its first place; sequences are
one after another. All three stay rows, numbered by ranges: no list of a key is made in one task unless it is asked for.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorium.sources.files import last_wins

from .ordered import numbered_within

#: How each of the store's collections is put together: by key, as list items of a key, or as sequences of a key.
#: Items and sequences have a column `seq`, their place in the key's list.
COLLECTIONS = {
    "devices": ("entity", ["device_uri"]),
    "measurements": ("entity", ["meas_uri"]),
    "rooms": ("entity", ["room_uri"]),
    "floors": ("entity", ["floor_uri"]),
    "property_types": ("list", ["property_type"]),
    "sequences": ("sequence", ["device_uri", "property_type"]),
}


def loaded(parts: list[DataFrame]) -> DataFrame:
    """The parts' rows with `load`, the number of their part."""
    if not parts:
        raise ValueError("no snapshots")
    out = parts[0].withColumn("load", F.lit(0))
    for k, p in enumerate(parts[1:], 1):
        out = out.unionByName(p.withColumn("load", F.lit(k)), allowMissingColumns=True)
    return out


def union_of_lists(parts: list[DataFrame], key: list[str], seq: str = "seq") -> DataFrame:
    """The different items of each key's lists, numbered from 0 by where they came first: load, then place in the list.

    Items are what the other columns say. Equal items are dropped by a hash aggregate, before anything is sorted.
    """
    items = [c for c in parts[0].columns if c not in (*key, seq)]
    first = loaded(parts).groupBy(*key, *items).agg(F.min(F.struct("load", seq)).alias("__first"))
    return numbered_within(first, key, ["__first", *items], seq).select(*key, seq, *items)


def joined_sequences(parts: list[DataFrame], key: list[str], seq: str = "seq") -> DataFrame:
    """The items of each key's sequences one part after another, equal ones too, numbered from 0."""
    rows = loaded(parts)
    items = [c for c in rows.columns if c not in (*key, seq, "load")]
    return numbered_within(rows.withColumnRenamed(seq, "__seq"), key, ["load", "__seq", *items], seq).select(*key, seq, *items)


def merged(snapshots: list[dict[str, DataFrame]], collections: dict[str, tuple[str, list[str]]] = COLLECTIONS) -> dict[str, DataFrame]:
    """All collections that any of the snapshots has, put together; a snapshot that lacks one adds nothing to it."""
    how = {"entity": last_wins, "list": union_of_lists, "sequence": joined_sequences}
    out = {}
    for name in dict.fromkeys(n for s in snapshots for n in s):
        if name not in collections:
            raise ValueError(f"unknown collection {name}")
        kind, key = collections[name]
        out[name] = how[kind]([s[name] for s in snapshots if name in s], key)
    return out


def as_lists(rows: DataFrame, key: list[str], item: str, seq: str = "seq") -> DataFrame:
    """key and an array of its items in order: for short lists."""
    return rows.groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct(seq, item))), lambda x: x[item]).alias(item))
