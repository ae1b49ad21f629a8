"""Project folders: encoding, decoding and short names."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

WORKTREES = "--worktrees-"


def encode_path(col: Column) -> Column:
    """Everything but ASCII letters, digits and dashes becomes a dash."""
    return F.regexp_replace(col, "[^A-Za-z0-9-]", "-")


def project_root(col: Column) -> Column:
    """The encoded main project of a worktree's folder."""
    return F.substring_index(col, WORKTREES, 1)


def _runs(col: Column, of_run) -> Column:
    runs = F.regexp_extract_all(col, F.lit("(-+|[^-]+)"), F.lit(1))
    return F.array_join(F.transform(runs, lambda r: F.when(F.startswith(r, F.lit("-")), of_run(F.length(r))).otherwise(r)), "")


def decode_path(col: Column) -> Column:
    """A path that may have been encoded: one dash is a slash, two are two underscores."""
    def of_run(n: Column) -> Column:
        longer = F.concat(F.lit("/"), F.repeat(F.lit("__"), F.floor((n - 1) / 2).cast("int")), F.when((n - 1) % 2 == 1, "/").otherwise(""))
        return F.when(n == 1, "/").when(n == 2, "__").otherwise(longer)

    return _runs(col, of_run)


def display_path(col: Column) -> Column:
    """For display: an odd run is a slash and underscores, an even run underscores."""
    return _runs(col, lambda n: F.when(n % 2 == 1, F.concat(F.lit("/"), F.repeat(F.lit("_"), n - 1))).otherwise(F.repeat(F.lit("_"), n)))


def short_name(col: Column) -> Column:
    """``project/worktree`` of a worktree's path, else the last component."""
    mark = F.when(F.contains(col, F.lit("__worktrees/")), F.lit("__worktrees/")).when(F.contains(col, F.lit("/.worktrees/")), F.lit("/.worktrees/"))
    at = F.locate("__worktrees/", col)
    at = F.when(at > 0, at).otherwise(F.locate("/.worktrees/", col))
    main = F.element_at(F.split(F.rtrim(F.left(col, at - 1), F.lit("/")), "/"), -1)
    tree = F.element_at(F.split(F.substring(col, at + F.length(mark), F.length(col)), "/"), 1)
    last = F.element_at(F.split(F.rtrim(col, F.lit("/")), "/"), -1)
    return F.when(mark.isNotNull() & (main != "") & (tree != ""), F.concat(main, F.lit("/"), tree)).otherwise(F.when(last == "", col).otherwise(last))
