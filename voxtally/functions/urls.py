"""Video addresses.

The parts of an address are cut out by pattern, following the generic syntax of
RFC 3986. ``try_parse_url`` is stricter than what users paste (it refuses spaces
and unescaped letters), and a comment request must not get lost over that.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values -----------------------------------------------------------------
SHORT_HOST = "youtu.be"
LONG_HOST = "youtube.com"
CLIP_SEGMENT = "shorts"
VIDEO_PARAMETER = "v"
# ------------------------------------------------------------------------------

_AUTHORITY = r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//"
_HOST = r"[^/?#]*"
_HOST_END = r"[^/?#]*(?=[/?#]|$)"


def extract_video_id(
    url: Column | str,
    short_host: str = SHORT_HOST,
    long_host: str = LONG_HOST,
    clip_segment: str = CLIP_SEGMENT,
    parameter: str = VIDEO_PARAMETER,
) -> Column:
    """Id of the video an address points at, NULL where it points at none.

    A short address carries the id as its path, a clip as the last segment of the
    path, any other as a query parameter, of which the first that is not blank
    counts. Three patterns exclude each other, so that the id is what they give
    together and every pattern is tried once.
    """
    url = F.col(url) if isinstance(url, str) else url
    url = F.translate(F.ltrim(url), "\t\r\n", "")
    short, long = re.escape(short_host), re.escape(long_host)
    in_long = f"{_AUTHORITY}(?!{_HOST}{short}){_HOST}{long}{_HOST_END}"
    # Parameters after a semicolon in the last segment are not part of the path.
    clip = re.escape(clip_segment)
    in_clip = f"(?=(?:[^?#]*/)?[^/?#;]*{clip}|[^?#]*{clip}[^?#]*/)"

    by_path = F.regexp_extract(
        url, f"{_AUTHORITY}{_HOST}{short}{_HOST_END}/+([^?#]*?)(?:;[^/?#]*)?(?:[?#]|$)", 1
    )
    by_segment = F.regexp_extract(
        url, f"{in_long}{in_clip}[^?#]*/([^/?#;]*)(?:;[^/?#]*)?(?:[?#]|$)", 1
    )
    by_parameter = F.regexp_extract(
        url, f"{in_long}(?!{in_clip})[^?#]*[?](?:[^#]*?&)??{re.escape(parameter)}=([^&#]+)", 1
    )
    # A percent sign that starts no escape is meant literally.
    escaped = F.regexp_replace(by_parameter, "%(?![0-9A-Fa-f]{2})", "%25")
    found = F.concat(by_path, by_segment, F.url_decode(escaped))
    return F.when(found != "", found)


def is_video_url(
    text: Column | str,
    patterns: Sequence[str] = (
        r"youtube\.com/watch\?v=",
        r"youtu\.be/",
        r"youtube\.com/shorts/",
    ),
) -> Column:
    """True where one of the address patterns occurs anywhere in the text."""
    text = F.col(text) if isinstance(text, str) else text
    return text.rlike("|".join(patterns))
