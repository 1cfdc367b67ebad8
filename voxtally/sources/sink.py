"""CSV output."""

from __future__ import annotations

import logging
from datetime import datetime

from pyspark.sql import DataFrame

from ..session import SPARK_ERRORS

log = logging.getLogger(__name__)

# What file systems say of a path that cannot be written.
PATH_SIGNS = ("Permission denied", "AccessControlException", "AccessDenied", "Mkdirs failed", "Read-only file system",
              "FileAlreadyExists", "Parent path is not a directory", "Not a directory", "Unable to clear output directory",
              "is a directory")


def write_csv(df: DataFrame, folder: str, name: str, single_file: bool = False) -> str:
    """Write ``folder/name`` (a directory of CSV parts) and return its path.

    If the path cannot be written, a time-stamped path beside it is used; any
    other error, as of the query itself, is passed on. One file only on request,
    since that is one task.
    """
    out = df.coalesce(1) if single_file else df
    path = f"{folder.rstrip('/')}/{name}"

    def write(to: str) -> str:
        (out.write.mode("overwrite").option("header", True).option("quote", '"')
         .option("escape", '"').option("emptyValue", "").csv(to))
        return to

    try:
        return write(path)
    except SPARK_ERRORS as error:
        if not _of_the_path(error):
            raise
        other = f"{path}_{datetime.now():%Y%m%d_%H%M%S}"
        log.warning("could not write %s (%s); writing %s", path, error, other)
        return write(other)


def _of_the_path(error: Exception) -> bool:
    """Whether the folder itself refused: no permission, in the way, read-only.

    A failed job says so, whatever its tasks ran into.
    """
    text = str(error)
    return "Job aborted" not in text and any(sign in text for sign in PATH_SIGNS)
