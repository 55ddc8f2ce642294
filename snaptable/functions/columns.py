"""Column functions of general use."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def mask_credentials(url: Column) -> Column:
    """The password in a URL's user part becomes ****; text without one is unchanged."""
    return F.regexp_replace(url, "(://[^:/?#@]*):[^/?#]*@", "$1:****@")


def tag_append(tags: Column, tag: Column) -> Column:
    """The tag at the end of the list, unless it is in it."""
    own = F.coalesce(tags, F.array().cast("array<string>"))
    return F.when(F.array_contains(own, tag), own).otherwise(F.array_append(own, tag))


def is_tagged(tags: Column) -> Column:
    return F.coalesce(F.size(tags), F.lit(0)) > 0
