"""Names, paths and nested records."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def range_list(spec: Column) -> Column:
    """'0,2-5' as sorted distinct numbers; blanks are ignored."""
    parts = F.filter(F.transform(F.split(spec, ","), lambda p: F.trim(p)), lambda p: p != "")
    ends = lambda p: F.transform(F.split(p, "-"), lambda v: F.trim(v).cast("int"))
    ranges = F.transform(parts, lambda p: F.sequence(F.element_at(ends(p), 1), F.element_at(ends(p), -1)))
    return F.array_sort(F.array_distinct(F.flatten(ranges)))


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def view_name(view: Column) -> Column:
    return F.format_string("view%02d", view)


def folder_kind(name: Column) -> Column:
    """A folder's name without its trailing number, and so without its resolution."""
    return F.regexp_replace(name, r"_\d+$", "")


def folder_resolution(name: Column) -> Column:
    """The trailing number of a folder's name, null without one."""
    found = F.regexp_extract(name, r"_(\d+)$", 1)
    return F.when(found != "", found.cast("int"))


def is_view_folder(name: Column) -> Column:
    return folder_kind(name).endswith("_view") | folder_kind(name).endswith("_view_fix")


def flat_entries(record: Column, separator: str = ".") -> Column:
    """(key, value) entries of a JSON object of numbers and objects of numbers."""
    top = F.from_json(record, "map<string,string>")
    entries = F.transform(F.map_entries(top), lambda e: F.transform(
        F.coalesce(F.map_entries(F.from_json(e["value"], "map<string,string>")), F.array(F.struct(F.lit("").alias("key"), e["value"].alias("value")))),
        lambda x: F.struct(F.when(x["key"] == "", e["key"]).otherwise(F.concat_ws(separator, e["key"], x["key"])).alias("key"), x["value"].try_cast("double").alias("value")),
    ))
    return F.flatten(entries)


def any_leaf(record: Column, test) -> Column:
    """Whether a number of the record, at any depth that `flat_entries` reads, passes the test."""
    return F.exists(flat_entries(record), lambda e: F.coalesce(test(e["value"]), F.lit(False)))


def all_leaves(record: Column, test) -> Column:
    return F.forall(flat_entries(record), lambda e: F.coalesce(test(e["value"]), F.lit(False)))
