"""Text, path and key expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from likeness.settings import MISSING_TOKENS, SEED


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def is_missing(c) -> Column:
    c = _col(c).cast("string")
    return c.isNull() | F.regexp_replace(c, r"^\s+|\s+$", "").isin(MISSING_TOKENS)


def missing_to_null(c) -> Column:
    c = _col(c)
    return F.when(~is_missing(c), c)


def draw_key(purpose: str, *cols, seed=SEED) -> Column:
    """A reproducible random order: md5 of seed, purpose and keys.

    It depends on the row only, so it is the same for every partitioning and on every retry.
    """
    parts = [F.lit(str(seed)), F.lit(purpose)] + [_col(c).cast("string") for c in cols]
    return F.md5(F.concat_ws("|", *parts))


def model_from_dir(path) -> Column:
    """``.../<stamp>___<model>-<dataset>/...`` -> model."""
    return F.regexp_extract(_col(path), r"[^/]*?___([^/]*)-[^-/]+/", 1)


def item_from_file(path, model) -> Column:
    """``<item>_<model>.npy`` -> item; null when the file belongs to another model."""
    name = F.substring_index(_col(path), "/", -1)
    suffix = F.concat(F.lit("_"), _col(model), F.lit(".npy"))
    return F.when(
        F.endswith(name, suffix), F.left(name, F.length(name) - F.length(suffix))
    )


def human_size(nbytes) -> Column:
    """1536 -> ``1.5 KB``."""
    b = _col(nbytes).cast("double")
    return (
        F.when(b < 1024, F.format_string("%.0f B", b))
        .when(b < 1024**2, F.format_string("%.1f KB", F.bround(b / 1024, 1)))
        .when(b < 1024**3, F.format_string("%.1f MB", F.bround(b / 1024**2, 1)))
        .otherwise(F.format_string("%.1f GB", F.bround(b / 1024**3, 1)))
    )


def text_md5(c) -> Column:
    """md5 of a text with every line ending read as a line feed."""
    return F.md5(F.replace(_col(c), F.lit("\r\n"), F.lit("\n")))


def package_name(c) -> Column:
    return F.lower(F.regexp_replace(_col(c), r"[-_.]+", "-"))


def row_md5(*cols) -> Column:
    """md5 of a row; nulls are told apart from empty text."""
    return F.md5(
        F.concat_ws("\x1f", *[F.coalesce(_col(c).cast("string"), F.lit("\x00")) for c in cols])
    )
