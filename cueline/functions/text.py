"""Column functions over cue text: trimming, bilingual splits, time stamps and long-text splits.

All are compositions of built-in functions, but for the split of long texts, which is a fold over pieces: there
Arrow batches of texts go through a small Python function in linear time. Where Java's defaults differ from the
text rules that subtitle files are written under (which blanks are trimmed, which digits
count, how hundredths are rounded), the difference is stated at the function.
"""

from __future__ import annotations

import re
import sys
import unicodedata

import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from cueline.functions.workers import reach_in_small_batches

# The characters that are trimmed: all that Unicode calls white space, and the four ASCII separators.
BLANKS = "".join(c for c in map(chr, range(sys.maxunicode + 1)) if c.isspace())
# A subtitle line, "[mm:ss.xx]text", in decimal digits of any script.
LRC_LINE = r"(?s)^\[(\p{Nd}{2}):(\p{Nd}{2})\.(\p{Nd}{2,3})\](.+)"
# Marks that end a sentence, and marks that part clauses.
STRONG, WEAK = "。！？!?.;；\n", "，、,"
#: Texts whose pieces are Python objects at a time.
AT_ONCE = 64
_STRONG_RUNS, _WEAK_RUNS = (re.compile(f"[^{marks}]*[{marks}]+|[^{marks}]+") for marks in (STRONG, WEAK))

DIGITS = "".join(c for c in map(chr, range(sys.maxunicode + 1)) if unicodedata.category(c) == "Nd")
AS_ASCII = "".join(str(unicodedata.digit(c)) for c in DIGITS)


def strip_all(text: Column) -> Column:
    """Without leading and trailing white space of any kind (``trim`` alone takes blanks only)."""
    return F.trim(text, F.lit(BLANKS))


def lines_of(content: Column) -> Column:
    """Lines of a whole file, ended by CR LF, CR or LF."""
    return F.split(content, "\r\n|\r|\n")


def split_bilingual(text: Column, delimiter: str = "|||", strategy: str = "last") -> tuple[Column, Column]:
    """Target and native part around the last (else the first) delimiter, trimmed; without one, all is target.

    An empty delimiter is found at the end, or at the start if the first counts.
    """
    if not delimiter:
        whole, none = strip_all(text), F.when(text.isNotNull(), F.lit(""))
        return (whole, none) if strategy == "last" else (none, whole)
    there, n = F.contains(text, F.lit(delimiter)), len(delimiter)
    if strategy == "last":
        right = F.substring_index(text, delimiter, -1)
        left = F.substr(text, F.lit(1), F.length(text) - F.length(right) - n)
    else:
        at = F.locate(delimiter, text)
        left, right = F.substr(text, F.lit(1), at - 1), F.substr(text, at + n)
    return strip_all(F.when(there, left).otherwise(text)), strip_all(F.when(there, right).otherwise(F.when(text.isNotNull(), "")))


def parsed_cue(line: Column, delimiter: str = "|||", strategy: str = "last") -> Column:
    """An array of the one cue (``start_ms``, ``target_text``, ``native_text``) of a subtitle line; empty if it is none.

    Only the first stamp counts, and a cue needs a native part. Made for ``inline``, which reads each line once.
    """
    part = [F.regexp_extract(line, LRC_LINE, k) for k in range(1, 5)]
    found = F.array(F.struct(F.translate(F.concat(*part[:3]), DIGITS, AS_ASCII).alias("digits"), part[3].alias("body")))

    def cue(x: Column) -> Column:
        at = lambda start, n: F.substr(x["digits"], F.lit(start), F.lit(n)).try_cast("bigint")
        target, native = split_bilingual(x["body"], delimiter, strategy)
        start = at(1, 2) * 60_000 + at(3, 2) * 1000 + at(5, 3) * F.when(F.length(x["digits"]) == 6, 10).otherwise(1)
        return F.struct(start.alias("start_ms"), target.alias("target_text"), native.alias("native_text"))

    return F.filter(F.transform(F.filter(found, lambda x: x["body"] != ""), cue), lambda x: x["native_text"] != "")


def _hundredths(ms: Column) -> Column:
    """Hundredths of a second of ``ms`` within its minute, rounded as the binary value of the seconds is.

    A trailing 5 ms is a tie in decimal, but not in binary: the seconds' fraction is scaled to an
    integer in two exact steps and compared with the middle.
    """
    seconds = (ms / F.lit(1000.0)) % F.lit(60.0)
    whole = F.floor(seconds)
    cs = F.floor((ms % 1000) / 10)
    scaled = (seconds - whole) * F.lit(2.0**52)
    high = F.floor(scaled)
    exact = high.cast("decimal(38,0)") * 256 + F.floor((scaled - high) * 256).cast("decimal(38,0)")
    twice, middle = exact * 200, (2 * cs + 1).cast("decimal(38,0)") * F.lit(2**60).cast("decimal(38,0)")
    up = F.when(ms % 10 != 5, ms % 10 > 5).otherwise((twice > middle) | ((twice == middle) & (cs % 2 == 1)))
    return whole * 100 + cs + F.when(up, 1).otherwise(0)


def clock(ms: Column) -> Column:
    """``mm:ss.xx``; minutes grow beyond two digits, and seconds may round to 60.00."""
    cs = _hundredths(ms)
    minutes = F.floor((ms / F.lit(1000.0)) / 60).cast("string")
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    return F.concat(F.lpad(minutes, F.greatest(F.lit(2), F.length(minutes)), F.lit("0")), F.lit(":"), two(F.floor(cs / 100)), F.lit("."), two(cs % 100))


def lrc_stamp(ms: Column) -> Column:
    return F.concat(F.lit("["), clock(ms), F.lit("]"))


def seconds_to_ms(seconds: Column) -> Column:
    """Whole ms, cut off."""
    return (seconds.cast("double") * F.lit(1000.0)).cast("bigint")


def short_duration(seconds: Column) -> Column:
    """``mm:ss``, cut off."""
    minutes = F.floor(seconds / 60).cast("string")
    return F.concat(F.lpad(minutes, F.greatest(F.lit(2), F.length(minutes)), F.lit("0")), F.lit(":"), F.lpad(F.floor(seconds % 60).cast("string"), 2, "0"))


def byte_size(n: Column) -> Column:
    """``n B``, or KB and MB with one decimal, ties to even."""
    one = lambda x: F.bround(x.cast("decimal(38,20)"), 1).cast("decimal(20,1)").cast("string")
    return (
        F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B")))
        .when(n < 1024 * 1024, F.concat(one(n / F.lit(1024.0)), F.lit(" KB")))
        .otherwise(F.concat(one(n / F.lit(1048576.0)), F.lit(" MB")))
    )


def preview(text: Column, n: int) -> Column:
    return F.substring(text, 1, n)


def snippet(text: Column) -> Column:
    """The first 30 characters on one line, for logs."""
    return F.replace(F.substring(text, 1, 30), F.lit("\n"), F.lit(" "))


def shortened(text: Column, limit: int) -> Column:
    """Texts over ``limit`` are cut three characters below it and dotted."""
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit - 3), F.lit("..."))).otherwise(text)


def last_items(items: Column, n: int) -> Column:
    return F.slice(items, F.greatest(F.size(items) - n + 1, F.lit(1)), n)


def has_strong(text: Column) -> Column:
    return text.rlike(f"[{STRONG}]")


def _pieces(text: str, runs: re.Pattern[str]) -> list[str]:
    """Pieces that end in runs of marks, trimmed, without empty ones."""
    return [piece for x in runs.findall(text) if (piece := x.strip())]


def sentences_of(text: str) -> list[str]:
    return _pieces(text, _STRONG_RUNS)


def speakable(text: str, target: int = 80, weak: int = 50) -> list[str]:
    """The pieces of :func:`split_long_text` for one text."""
    whole = text.strip()
    parts: list[str] = []
    for sentence in sentences_of(whole) or ([whole] if whole else []):
        clauses = [sentence] if len(sentence) <= target else _pieces(sentence, _WEAK_RUNS)
        parts += clauses if len(clauses) > 1 or len(sentence) <= target else [sentence[i : i + weak] for i in range(0, len(sentence), weak)]
    out: list[str] = []
    now: list[str] = []
    size, strong = 0, False
    for part in parts:
        ends = part[-1:] in STRONG
        if now and size + len(part) > (target if strong or ends else weak):
            out.append("".join(now))
            now, size, strong = [], 0, False
        now.append(part)
        size, strong = size + len(part), strong or ends
    return [*out, "".join(now)] if now else out


def split_long_text(text: Column, target: int = 80, weak: int = 50) -> Column:
    """Speakable pieces: sentences, long ones parted at clauses or cut, then bundled greedily.

    A bundle may grow to ``target`` characters if it has a sentence mark, else to ``weak``. Pieces are
    trimmed and joined without a blank; one that has no mark to be parted at is cut every ``weak`` characters.
    """
    reach_in_small_batches(SparkSession.getActiveSession())

    @F.arrow_udf("array<string>")
    def split(texts: pa.Array) -> pa.Array:
        # The pieces of a few texts at a time are Python's; Arrow holds them in far less.
        parts = (texts.slice(i, AT_ONCE).to_pylist() for i in range(0, len(texts), AT_ONCE))
        made = [pa.array([None if t is None else speakable(t, target, weak) for t in part], pa.list_(pa.string())) for part in parts]
        return pa.concat_arrays([pa.array([], pa.list_(pa.string())), *made])

    return split(text)
