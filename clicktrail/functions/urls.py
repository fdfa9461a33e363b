"""Domain of a URL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from clicktrail.functions.text import as_column, trim_control

# The host guess for URLs that no URI parser accepts, and the second-last label of a
# host (dots at the end do not count; without a second label nothing matches and the host stays).
HOST_GUESS = r"^(?:https?://)?(?:www\.)?([^/]+)"
SECOND_LAST_LABEL = r"(?s)^(?:.*\.)?([^.]*)\.[^.]+\.*\z"


def extract_domain(url: Column | str) -> Column:
    """Second-last host label: ``news.site.com`` gives ``site``; a one-label host stays whole.

    The letter case is kept. URLs whose host does not parse (underscore, blank, non-ASCII host) are
    read by pattern from the text as given. Empty or null gives ``""``.
    """
    raw = as_column(url)
    c = trim_control(raw)
    with_scheme = F.when(F.contains(c, F.lit("://")), c).otherwise(F.concat(F.lit("http://"), c))
    host = F.coalesce(
        F.try_parse_url(with_scheme, F.lit("HOST")),
        F.regexp_extract(F.when(c == "", "").otherwise(raw), HOST_GUESS, 1),
    )
    # Without a dot at the end, which is nearly always, two cuts do what the pattern does. The host stands
    # in the first test, outside any branch, so that generated code computes it once.
    label = F.when(
        ~F.endswith(host, F.lit(".")), F.substring_index(F.substring_index(host, ".", -2), ".", 1)
    ).otherwise(F.regexp_replace(host, SECOND_LAST_LABEL, "$1"))
    return F.coalesce(label, F.lit(""))
