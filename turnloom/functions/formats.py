"""Forms of single values: numbers and times of reports, merged maps, texts for speech, and lineage of a run."""

from __future__ import annotations

import subprocess

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Ranges of emoji and their joiners and selectors.
EMOJI = r"[\x{1F000}-\x{1FAFF}\x{2600}-\x{27BF}\x{2B00}-\x{2BFF}\x{FE0E}\x{FE0F}\x{200D}\x{E0020}-\x{E007F}]"


def fixed(value: Column, digits: int = 3) -> Column:
    """A number with so many digits and no thousands separators; a dash for null and NaN."""
    number = value.cast("double")
    return F.when(number.isNull() | F.isnan(number), "—").otherwise(F.format_string(f"%.{digits}f", number))


def utc_stamp(at: Column) -> Column:
    """A time (without zone, in UTC) as ``yyyy-MM-ddTHH:mm:ss.SSSSSS+00:00``."""
    return F.concat(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("+00:00"))


def merged(base: Column, over: Column) -> Column:
    """Two maps as one, the second's values winning; a null map counts as empty."""
    left = F.map_filter(base, lambda k, v: ~F.coalesce(F.map_contains_key(over, k), F.lit(False)))
    return F.coalesce(F.when(base.isNull(), over), F.when(over.isNull(), base), F.map_concat(left, over))


def without_emoji(text: Column) -> Column:
    return F.regexp_replace(text, EMOJI, "")


def l2_norm(values: Column) -> Column:
    """Length of a vector of numbers; 0 for an empty one, nulls counting as 0."""
    return F.sqrt(F.aggregate(values, F.lit(0.0), lambda a, x: a + F.coalesce(x.cast("double"), F.lit(0.0)) * F.coalesce(x.cast("double"), F.lit(0.0))))


def git_identity(repository: str) -> dict[str, str]:
    """Commit of a repository, and whether it has changes; empty texts where git can't tell."""

    def run(*arguments: str) -> str:
        done = subprocess.run(["git", "-C", repository, *arguments], capture_output=True, text=True, check=False)
        return done.stdout.strip() if done.returncode == 0 else ""

    return {"commit": run("rev-parse", "HEAD"), "changed": "yes" if run("status", "--porcelain") else ""}
