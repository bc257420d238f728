"""Column expressions for text: ids, links, times and token counts."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# Address of a video, playlist prefixes, and the pattern after the
# published cl100k pre-tokenizer, in a form that Java, RE2 and Python's `regex`
# read alike.
WATCH_URL = "https://www.youtube.com/watch?v="
VIDEOS_PLAYLIST_PREFIX = "UULF"
UPLOADS_PLAYLIST_PREFIX = "UU"
PRETOKEN = (
    r"'(?i:[sdmt]|ll|ve|re)"
    r"|[^\r\n\p{L}\p{N}]?\p{L}+"
    r"|\p{N}{1,3}"
    r"| ?[^\s\p{L}\p{N}]+[\r\n]*"
    r"|\s+"
)

# The characters Python's str.strip() removes.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)


def watch_url(video_id: Column) -> Column:
    return F.concat(F.lit(WATCH_URL), video_id)


def playlist_id(channel_id: Column, prefix: str = VIDEOS_PLAYLIST_PREFIX) -> Column:
    """A channel's playlist: its id without the first two characters, prefixed."""
    return F.concat(F.lit(prefix), F.substring(channel_id, 3, 2**31 - 1))


def published_at(text: Column) -> Column:
    """ISO-8601 text to a timestamp; text that is no time is an error in any session."""
    time = F.try_to_timestamp(text)
    wrong = F.raise_error(F.concat(F.lit("not a time: "), text)).cast("timestamp")
    return F.when(text.isNull() | time.isNotNull(), time).otherwise(wrong)


def passage_id(channel_id: Column, video_id: Column, position: Column) -> Column:
    """``channel_video_position``; null when any part is null."""
    return F.concat(channel_id, F.lit("_"), video_id, F.lit("_"), position)


def join_text(texts: Column, separator: str = " ") -> Column:
    """Array of strings to one string; null or empty array gives an empty string."""
    return F.concat_ws(separator, texts)


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITESPACE))


def pretoken_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(PRETOKEN))


def words(text: Column) -> Column:
    """Words between runs of blanks, tabs and line ends."""
    return F.filter(F.split(text, "[ \t\r\n]+"), lambda w: w != "")
