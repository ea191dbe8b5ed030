"""Text expressions for labels and file names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What a label and a file stem may consist of, and the capture suffix.
NOT_LABEL = "[^0-9a-zA-Z]+"
NOT_STEM = r"[^._\p{L}\p{N}]+"
CAPTURE_NAME = r"^(.*)\.pcap"


def clean_label(label: Column) -> Column:
    """Runs of anything but ASCII letters and digits become one underscore."""
    return F.regexp_replace(label.cast("string"), NOT_LABEL, "_")


def clean_stem(stem: Column) -> Column:
    """Runs of anything but letters and numbers of any script, underscores and dots become one underscore."""
    return F.regexp_replace(stem, NOT_STEM, "_")


def base_name(path: Column) -> Column:
    """The last path segment."""
    return F.regexp_extract(path, "([^/]*)$", 1)


def file_stem(path: Column) -> Column:
    """The last path segment without its final suffix."""
    return F.regexp_replace(base_name(path), r"(?<=.)\.[^.]*$", "")


def directory_label(path: Column) -> Column:
    """The name of the directory a file lies in."""
    return F.regexp_extract(path, "([^/]+)/[^/]+$", 1)


def local_path(uri: Column) -> Column:
    """The path of a file URI, as Spark reports it, without its scheme and encoding."""
    plain = F.url_decode(F.regexp_replace(uri, r"\+", "%2B"))
    return F.regexp_replace(plain, "^[a-z0-9]+:/+", "/")


def relative_directory(path: Column, root: str) -> Column:
    """The directory of a file below ``root``, "." for the root itself."""
    directory = F.regexp_replace(path, "/[^/]*$", "")
    inside = F.substr(directory, F.lit(len(root) + 1))
    return F.when(directory == root, ".").otherwise(F.regexp_replace(inside, "^/+", ""))


def class_name(file_name: Column) -> Column:
    """The class a capture is named after, ``name.pcap`` giving ``name``."""
    return F.regexp_extract(file_name, CAPTURE_NAME, 1)


def fold(label: Column) -> Column:
    """Case-insensitive ordering key."""
    return F.lower(label)


def folded_order(label: str) -> list[Column]:
    """Case-insensitive order, ties by the text itself so that it is total."""
    return [F.lower(F.col(label)).asc(), F.col(label).asc()]
