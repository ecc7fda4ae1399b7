"""File names by a convention, and names shortened to a length."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The longest name, the characters that stay, words that say little, numbers, years and months at a name's start.
LONGEST = 50
OTHER = r"[^A-Za-z0-9_\-]"
FILLER = r"(?i)^(?:draft|final|copy|version|ver|rev|v\d+)$"
COUNTER = r"^\d{1,3}$"
DATE = r"^(?:19|20)\d{2}(?:\d{2}(?:\d{2})?)?$"
MONTH = r"(?i)^(?:jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|sep(?:t(?:ember)?)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)$"
DIGEST = 6


def convention_name(year: Column, month: Column, mechanism: Column, pi: Column, project: Column, doctype: Column, draft: Column, ext: Column) -> Column:
    """year_month_mechanism_pi_project_doctype_draft_n.ext; blanks within project and doctype become underscores."""
    words = lambda c: F.replace(F.trim(c), F.lit(" "), F.lit("_"))
    dotted = F.when(ext.startswith("."), ext).otherwise(F.concat(F.lit("."), ext))
    return F.concat(F.concat_ws("_", year, month, mechanism, pi, words(project), words(doctype), F.lit("draft"), draft), dotted)


def _date_words(words: Column) -> Column:
    """How many words at the start are a date (2026_Oct, 2026_10_26, 202610); never all of them."""
    short = lambda i: F.get(words, i).rlike(r"^\d{1,2}$")
    plain_year = F.length(F.get(words, 0)) == 4
    n = F.when(plain_year & F.get(words, 1).rlike(MONTH), 2).when(plain_year & short(1) & short(2), 3).when(plain_year & short(1), 2).otherwise(1)
    return F.when(F.get(words, 0).rlike(DATE) & (n < F.size(words)), n).otherwise(0)


def _after(words: Column, n: Column) -> Column:
    return F.slice(words, n + 1, F.size(words))


def short_names(files: DataFrame, longest: int = LONGEST, drop_date: bool = False) -> DataFrame:
    """files(folder, pos, name) with ``short``: at most ``longest`` characters with the extension, one of a kind in its folder.

    A clean name that is short enough stays. Else characters outside A-Z, a-z, 0-9, _ and - become _, and words go until the
    name fits: fillers with their counters, the last first; a date at the start; words from the middle (after a date the third
    one, as long as more than three are left). What is still too long, or is the short form of an earlier file of its folder,
    becomes a digest of the whole name and the words at the end that fit. ``drop_date`` removes date and fillers from every
    name. Of equal names in a folder each further one has a digest of its own. Null names stay null.
    """
    fits = lambda words: F.length(F.array_join(words, "_")) + F.length("_ext") <= longest
    raw_ext = F.regexp_extract("name", r"(?s)^\.*[^.].*(\.[^.]*)$", 1)
    rows = files.withColumn("_stem", F.regexp_replace("name", r"(?s)^(\.*[^.].*)\.[^.]*$", "$1"))
    rows = rows.withColumn("_ext", F.when(raw_ext != "", F.concat(F.lit("."), F.regexp_replace(F.substr(raw_ext, F.lit(2)), OTHER, "_"))).otherwise(F.lit("")))
    rows = rows.withColumn("_clean", F.regexp_replace("_stem", OTHER, "_")).withColumn("_w", F.filter(F.split("_clean", "_"), lambda x: x != ""))
    rows = rows.withColumn("_w", F.when(F.size("_w") > 0, F.col("_w")).otherwise(F.array(F.lit("file"))))
    rows = rows.withColumn("_d", _date_words(F.col("_w")) if drop_date else F.lit(0)).withColumn("_w", _after(F.col("_w"), F.col("_d")))
    as_is = (F.col("_d") == 0) & (F.col("_clean") == F.col("_stem")) & (F.length("_clean") + F.length("_ext") <= longest)

    # a filler's group is its place from 1, its counter is in it; a counter at the end is a group of its own
    def group(x: Column, i: Column) -> Column:
        counts = x.rlike(COUNTER)
        follows = F.coalesce(F.get(F.col("_w"), i - 1).rlike(FILLER), F.lit(False))
        return F.when(x.rlike(FILLER), i + 1).when(counts & follows, i).when(counts & (i > 0) & (i == F.size("_w") - 1), i + 1).otherwise(0)

    rows = rows.withColumn("_g", F.transform("_w", lambda x, i: F.struct(x.alias("w"), group(x, i).alias("g"))))
    last_first = F.sort_array(F.array_distinct(F.filter(F.transform("_g", lambda x: x["g"]), lambda g: g > 0)), asc=False)
    plain = lambda kept: F.transform(kept, lambda x: x["w"])

    def without(kept: Column, g: Column) -> Column:
        rest = F.filter(kept, lambda x: x["g"] != g)
        stop = F.size(rest) == 0
        return F.when(stop if drop_date else stop | fits(plain(kept)), kept).otherwise(rest)

    rows = rows.withColumn("_w", plain(F.aggregate(last_first, F.col("_g"), without)))
    rows = rows.withColumn("_e", F.when((F.col("_d") == 0) & ~fits(F.col("_w")), _date_words(F.col("_w"))).otherwise(0)).withColumn("_w", _after(F.col("_w"), F.col("_e")))

    def thinned(words: Column, _: Column) -> Column:
        n = F.size(words)
        at = F.when((F.col("_d") + F.col("_e") > 0) & (n > 3), 2).otherwise(F.floor(n / 2).cast("int"))
        return F.when(fits(words) | (n <= 2), words).otherwise(F.concat(F.slice(words, F.lit(1), at), _after(words, at + 1)))

    rows = rows.withColumn("_w", F.aggregate(F.sequence(F.lit(1), F.size("_w")), F.col("_w"), thinned))
    found = F.when(as_is, F.concat("_clean", "_ext")).when(fits(F.col("_w")), F.concat(F.array_join("_w", "_"), F.col("_ext")))
    rows = rows.withColumn("_short", found)

    first = F.row_number().over(Window.partitionBy("folder", "_short").orderBy("pos", "name")) == 1
    rows = rows.withColumn("_own", F.col("_short").isNotNull() & first)
    again = F.row_number().over(Window.partitionBy("folder", "name", "_own").orderBy("pos"))
    rows = rows.withColumn("_h", F.substr(F.sha1(F.concat(F.col("name"), F.repeat(F.lit("+"), again - 1))), F.lit(1), F.lit(DIGEST)))
    room = F.lit(longest - DIGEST - 1) - F.length("_ext")
    ends = F.transform(F.sequence(F.lit(1), F.size("_w")), lambda i: F.array_join(F.slice(F.col("_w"), i, F.size("_w")), "_"))
    tail = F.coalesce(F.get(F.filter(ends, lambda x: F.length(x) <= room), 0), F.when(room > 0, F.right(F.element_at("_w", -1), room)), F.lit(""))
    digest = F.concat(F.col("_h"), F.when(tail != "", F.concat(F.lit("_"), tail)).otherwise(F.lit("")), F.col("_ext"))
    return rows.withColumn("short", F.when(F.col("name").isNotNull(), F.when(F.col("_own"), F.col("_short")).otherwise(digest))).select(*files.columns, "short")
