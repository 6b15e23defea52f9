"""Names and references as they are compared."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Blanks that are stripped at both ends of a name.
BLANKS = " \t\n\r\f\u000b   　﻿"


def same_name(c: Column | str) -> Column:
    """A name without blanks at both ends and in lower case; null stays null."""
    c = F.col(c) if isinstance(c, str) else c
    return F.lower(F.trim(c, F.lit(BLANKS)))
