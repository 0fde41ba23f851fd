"""Call verdicts from an acoustic spoof score and the content cascade."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CAUTION = 0.6


def compound(spoof: Column, content: Column) -> tuple[Column, Column]:
    """Confidence and kind of a call; null means that the signal is absent.

    ``content`` is the highest base score of the message's candidates.
    """
    acoustic = F.coalesce(spoof >= CAUTION, F.lit(False))
    words = content.isNotNull()
    score = (
        F.when(acoustic & words, F.least(F.lit(1.0), F.lit(0.5) * spoof + F.lit(0.5) * content + F.lit(0.1)))
        .when(acoustic, F.lit(0.5) * spoof)
        .when(words, F.lit(0.6) * content)
        .otherwise(0.0)
    )
    kind = (
        F.when(acoustic & words, "both").when(acoustic, "acoustic").when(words, "content").otherwise("none")
    )
    return F.round(score, 3), kind
