"""Path and name parsing as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The sources of the corpus.
SOURCES = ("corn_leaf_roboflow", "maize_africa", "maize_desease", "maize_field", "cropdg", "maize_nutrient", "multi_desease")


def decoded(path: Column) -> Column:
    """Percent escapes resolved (a malformed path stays as it is), backslashes turned, query string cut, blanks trimmed."""
    plain = F.when(F.instr(path, "%") > 0, F.coalesce(F.try_url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))), path)).otherwise(path)
    return F.trim(F.regexp_replace(F.translate(plain, "\\", "/"), r"[?#][^/]*$", ""))


def file_name(path: Column) -> Column:
    return F.element_at(F.split(decoded(path), "/"), -1)


def slugged_name(path: Column) -> Column:
    """File name in lower case with every run of blanks, hyphens and underscores as one underscore, framed by them."""
    return F.concat(F.lit("_"), F.regexp_replace(F.lower(file_name(path)), r"[\s_\-]+", "_"), F.lit("_"))


def source_in_name(path: Column, sources: tuple[str, ...] = SOURCES) -> Column:
    """The known source that the file name holds between separators, null without one."""
    return F.nullif(F.regexp_extract(slugged_name(path), "_(" + "|".join(sorted(sources, key=len, reverse=True)) + ")(?=[_.])", 1), F.lit(""))


def number_in_name(path: Column) -> Column:
    """The picture number: the run of digits in the file name that has 8 or 9 digits without its leading zeros."""
    return F.try_to_number(F.nullif(F.regexp_extract(slugged_name(path), r"(?<![0-9])0*([1-9][0-9]{7,8})(?![0-9])", 1), F.lit("")), F.lit("999999999")).cast("bigint")


def plot_folder(path: Column) -> Column:
    """The folder plot_... of a path, null without one."""
    return F.nullif(F.lower(F.regexp_extract(decoded(path), r"(?i)/(plot_[^/]+)/", 1)), F.lit(""))


def plain_path(path: Column) -> Column:
    """A path from its folder clean/ on, decoded and with single slashes: the same however the path is written."""
    p = F.regexp_replace(decoded(path), r"/+", "/")
    return F.regexp_replace(p, r"(?i)^.*?(?:^|/)clean/", "clean/")


def category(value: Column) -> Column:
    """A label or environment without regard to letter case, outer blanks and the kind of separator."""
    return F.regexp_replace(F.lower(F.regexp_replace(value, r"^[\s ]+|[\s ]+$", "")), r"[\s\-_]+", "_")
