"""Works as library items and back, kept documents' comments and changes, style suggestions."""

from __future__ import annotations

import heapq
import re
from collections import Counter
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Item types by kind of work, and what each type calls its fields; a field without a name there is dropped.
ITEM_TYPES = {
    "article-journal": "journalArticle", "article": "journalArticle", "paper-conference": "conferencePaper", "book": "book", "chapter": "bookSection",
    "journal-article": "journalArticle", "proceedings-article": "conferencePaper", "book-chapter": "bookSection", "posted-content": "preprint",
    "report": "report", "monograph": "book", "edited-book": "book", "reference-book": "book",
}
ITEM_FIELDS = {
    "journalArticle": {"journal": "publicationTitle", "volume": "volume", "issue": "issue", "pages": "pages"},
    "conferencePaper": {"journal": "proceedingsTitle", "volume": "volume", "pages": "pages"},
    "bookSection": {"journal": "bookTitle", "volume": "volume", "pages": "pages"},
    "book": {"volume": "volume"}, "report": {"pages": "pages"}, "preprint": {"journal": "repository"},
}
PREFS_CHUNK = 255
LEAST_KEPT = 8


def item_type(kind: Column, default: str = "journalArticle") -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for pair in ITEM_TYPES.items() for x in pair)), F.trim(kind)), F.lit(default))


def to_items(works: DataFrame) -> DataFrame:
    """works(pos, type, title, year, journal, volume, issue, pages, doi) -> pos, item_type, item: JSON with the fields that the type has."""
    blank = lambda c: F.coalesce(F.trim(c), F.lit(""))
    kind = item_type(F.col("type"))
    names = {n for fields in ITEM_FIELDS.values() for n in fields.values()}
    source = lambda n: [(t, s) for t, fields in ITEM_FIELDS.items() for s, m in fields.items() if m == n]
    fields = [F.coalesce(*(F.when(kind == t, blank(s)) for t, s in source(n))).alias(n) for n in sorted(names)]
    native = kind.isin(*ITEM_FIELDS)
    head = [kind.alias("itemType"), blank("title").alias("title"), blank("year").alias("date"), F.when(native, blank("doi")).alias("DOI"), F.when(~native & (blank("doi") != ""), F.concat(F.lit("DOI: "), blank("doi"))).alias("extra")]
    return works.select("pos", kind.alias("item_type"), F.to_json(F.struct(*head, *fields)).alias("item"))


def creators_to_authors(creators: Column) -> Column:
    """ARRAY<(creatorType, lastName, firstName, name)> -> "Family II" of authors; a single name as it is."""
    initials = lambda c: F.array_join(F.transform(F.filter(F.split(F.coalesce(c["firstName"], F.lit("")), r"\s+"), lambda w: w != ""), lambda w: F.upper(F.substr(w, F.lit(1), F.lit(1)))), "")
    one = lambda c: F.when(F.trim(c["lastName"]) != "", F.trim(F.concat(F.trim(c["lastName"]), F.lit(" "), initials(c)))).otherwise(F.nullif(F.trim(c["name"]), F.lit("")))
    return F.filter(F.transform(F.filter(creators, lambda c: F.coalesce(c["creatorType"] == "author", F.lit(True))), one), lambda x: x.isNotNull())


def prefs_chunks(text: Column, size: int = PREFS_CHUNK) -> Column:
    """A document's settings in pieces of a property's length; none for an empty text."""
    n = F.ceil(F.length(text) / F.lit(size)).cast("int")
    return F.when(n == 0, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.substr(text, (i - 1) * size + 1, F.lit(size))))


def number_comments(new: DataFrame, present: DataFrame) -> DataFrame:
    """new(doc, place) after present(doc, id) -> with id: the next free numbers of each document in order."""
    top = present.groupBy("doc").agg(F.max("id").alias("top"))
    k = F.row_number().over(Window.partitionBy("doc").orderBy("place"))
    return new.join(top, "doc", "left").withColumn("id", F.coalesce("top", F.lit(-1)) + k).drop("top")


def orphan_comments(comments: DataFrame, anchors: DataFrame) -> DataFrame:
    """comments(doc, id) that no anchor(doc, id) of any part names."""
    return comments.join(anchors.select("doc", "id"), ["doc", "id"], "left_anti")


def closest(key: str, keys: list[str], counts: np.ndarray, letters: dict[str, int], n: int) -> list[tuple[int, float]]:
    """Places and ratios of keys that may be among the n of the best matching ratio, equals included.

    A ratio is at most twice the common letters over the lengths. Keys are tried by that bound, until it is below the n-th best.
    """
    own = np.zeros(counts.shape[1], dtype=np.int32)
    for c, k in Counter(key).items():
        if c in letters:
            own[letters[c]] = k
    lengths = counts.sum(1) + len(key)
    bound = np.where(lengths > 0, 2.0 * np.minimum(counts, own).sum(1) / np.maximum(1, lengths), 1.0)
    found: list[tuple[int, float]] = []
    best: list[float] = []
    for i in np.argsort(-bound, kind="stable"):
        if len(best) == n and bound[i] < best[0] - 1e-12:
            break
        r = SequenceMatcher(None, key, keys[i]).ratio()
        found.append((int(i), r))
        heapq.heappush(best, r)
        if len(best) > n:
            heapq.heappop(best)
    return found


def _closest(n: int):
    def search(names: pd.DataFrame, styles: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(names) and len(styles):
            # keys of one style compete as one: the style's best counts
            by_key = styles.groupby("key")["style"].agg(list)
            keys = list(by_key.index)
            letters = {c: i for i, c in enumerate(sorted(set("".join(keys))))}
            counts = np.zeros((len(keys), max(1, len(letters))), dtype=np.int32)
            for i, k in enumerate(keys):
                for c, m in Counter(k).items():
                    counts[i, letters[c]] = m
            most = styles.groupby("style").size().max()
            for name in names["key"]:
                ratios: dict[str, float] = {}
                for i, r in closest(name, keys, counts, letters, n * int(most)):
                    for style in by_key.iloc[i]:
                        ratios[style] = max(ratios.get(style, 0.0), r)
                out += [(name, style, r) for style, r in sorted(ratios.items(), key=lambda x: (-x[1], x[0]))[:n]]
        return pd.DataFrame(out, columns=["key", "style", "ratio"])

    return search


def nearest_styles(names: DataFrame, styles: DataFrame, n: int = 3, chunk: int = 10_000) -> DataFrame:
    """names(name, key) against styles(style, key): the n of the best matching ratio, the smaller id of equals.

    Blocks of different names meet blocks of the catalogue, ``chunk`` rows each; common letters bound the ratio, so that few pairs are
    compared in full. Null keys count as empty.
    """
    key = F.coalesce("key", F.lit(""))
    asked, given = names.select(key.alias("key")).distinct(), styles.select(F.col("style").cast("string").alias("style"), key.alias("key")).distinct()
    parts, slots = max(1, -(-given.count() // chunk)), max(int(names.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-asked.count() // chunk))
    every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    left = asked.withColumn("slot", F.pmod(F.xxhash64("key"), F.lit(slots)).cast("int")).withColumn("part", every(parts))
    right = given.withColumn("part", F.pmod(F.xxhash64("style"), F.lit(parts)).cast("int")).withColumn("slot", every(slots))
    search = _closest(n)
    found = left.groupBy("part", "slot").cogroup(right.groupBy("part", "slot")).applyInPandas(lambda a, b: search(a, b), "key string, style string, ratio double")
    place = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("ratio"), "style"))
    best = found.withColumn("rank", place).where(F.col("rank") <= n)
    return names.select("name", key.alias("key")).join(best, "key").select("name", "style", "ratio", "rank")


def _redline(old: str, new: str) -> list[dict]:
    """Word by word. A kept stretch between two edits stands for itself only if it has LEAST_KEPT characters, white space at
    its ends aside; a shorter one joins the edits on both sides. Kept text before the first and after the last edit stays."""
    a, b = re.findall(r"^\s+|\S+\s*", old), re.findall(r"^\s+|\S+\s*", new)
    steps = [(op == "equal", "".join(a[i:j]), "".join(b[k:m])) for op, i, j, k, m in SequenceMatcher(None, a, b, autojunk=False).get_opcodes()]
    edits = [k for k, step in enumerate(steps) if not step[0]]
    out: list[list] = []
    for k, (same, x, y) in enumerate(steps):
        stays = same and (not edits or k < edits[0] or k > edits[-1] or len(x.strip()) >= LEAST_KEPT)
        if out and not stays and not out[-1][0]:
            out[-1][1] += x
            out[-1][2] += y
        else:
            out.append([stays, x, y])
    return [{"op": "equal" if s else "delete" if not y else "insert" if not x else "replace", "old": x, "new": y} for s, x, y in out]


def redline(old: Column, new: Column) -> Column:
    """ARRAY<(op, old, new)>: joined, the old parts give the old text and the new parts the new one; a null counts as empty."""
    f = F.pandas_udf(lambda a, b: pd.Series([_redline(x or "", y or "") for x, y in zip(a, b, strict=True)]), "array<struct<op:string,old:string,new:string>>")
    return f(old, new)
