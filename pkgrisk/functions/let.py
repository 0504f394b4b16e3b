"""Name an intermediate value inside one Column."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it any number of times in ``body``.

    Without it an expression that uses a part several times grows with every
    level, in plan size and in work.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))
