"""Classifications: responses and errors as struct columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def http_outcome(status: Column) -> Column:
    """struct(code, retryable, blocked) of a fetch by its status; null where it succeeded or never answered."""
    code = (
        F.when(status.isNull() | status.between(200, 299), None).when(status == 408, "REQUEST_TIMEOUT").when(status == 429, "RATE_LIMITED").when(status >= 500, "HTTP_SERVER_ERROR")
        .when(status.isin(401, 403), "ACCESS_RESTRICTED").otherwise("HTTP_CLIENT_ERROR")
    )
    retryable = status.isin(408, 429) | (status >= 500)
    return F.when(code.isNotNull(), F.struct(code.alias("code"), retryable.alias("retryable"), status.isin(401, 403).alias("blocked")))


def robots_outcome(status: Column) -> Column:
    """What a robots.txt answer means: use it, allow all, or try again."""
    return F.when(status.between(200, 299), "USE").when(status.between(400, 499) & ~status.isin(408, 429), "ALLOW_ALL").otherwise("RETRY")


def progress_status(total: Column, succeeded: Column, failed: Column) -> Column:
    """RUNNING until every source ended; then COMPLETED, FAILED or PARTIAL."""
    done = (total > 0) & (succeeded + failed == total)
    return F.when(~done, "RUNNING").when(succeeded == total, "COMPLETED").when(failed == total, "FAILED").otherwise("PARTIAL")


def duration_text(milliseconds: Column) -> Column:
    """59s, 1m 5s, 2h 3m."""
    s = F.floor(milliseconds / 1000)
    m = F.floor(s / 60)
    return (
        F.when(s < 60, F.concat(s.cast("string"), F.lit("s")))
        .when(m < 60, F.concat(m.cast("string"), F.lit("m "), (s % 60).cast("string"), F.lit("s")))
        .otherwise(F.concat(F.floor(m / 60).cast("string"), F.lit("h "), (m % 60).cast("string"), F.lit("m")))
    )
