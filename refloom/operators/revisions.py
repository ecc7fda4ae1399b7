"""Nested fields and tracked changes of documents given as tokens: structure, repair, resolving all changes, paragraphs put in or struck.

Tokens are rows (doc, part, para, pos, kind, text, flags) as ``sources.docx`` reads them. Besides text and field marks there are
comment marks (``cstart``, ``cend``, ``cref``: the comment's id), tracked paragraph marks (``pmark``), property changes (``fmt``:
JSON of scope, now, prior) and tracked changes of a table's geometry (``geom``: the element).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from refloom.functions.citations import field_kind

FLAGS = ("in_ins", "in_del", "in_move_from", "in_move_to")
COMMENT_MARKS = ("cstart", "cend", "cref")
_KEY = ("doc", "part")


def _fld(text: str) -> Column:
    return (F.col("kind") == "fld") & (F.col("text") == text)


def by_part(tokens: DataFrame) -> DataFrame:
    """Tokens dealt by part to four tasks a core, at most to as many as shuffles have. Left to their compressed bytes, millions of small
    rows are put together in one task, whose sorts hold them unpacked all at once."""
    spark = tokens.sparkSession
    return tokens.repartition(min(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism), *_KEY)


def _levels(tokens: DataFrame) -> DataFrame:
    """Tokens with ``depth``, the number of fields open before them, and ``place``, their number in the part.

    An end without a begin counts for nothing: it is one at which the running balance falls to a new low, so the balance over
    its lowest value so far is the depth.
    """
    w = Window.partitionBy(*_KEY).orderBy("pos")
    step = F.when(_fld("begin"), 1).when(_fld("end"), -1).otherwise(0)
    rows = by_part(tokens).withColumns({"_sum": F.sum(step).over(w), "place": F.row_number().over(w)})
    rows = rows.withColumn("_low", F.least(F.lit(0), F.min("_sum").over(w)))
    rows = rows.withColumn("_open", F.col("_sum") - F.col("_low"))
    # at an end that closes something one more was open; one that closes nothing sets a new low, where the balance stays 0
    before = F.coalesce(F.lag("_open").over(w), F.lit(0))
    return rows.withColumn("depth", before).drop("_sum", "_low", "_open")


def nested_fields(tokens: DataFrame) -> DataFrame:
    """Every complete complex field, inner ones too: doc, part, begin, separate, end (places), level (1 outermost), parent (the begin
    of the innermost field around it, which may lack an end itself), kind, code (live instruction), instruction (struck text
    included), members (tokens after begin up to end), rank (by end, so an inner field before its outer one).

    Ends without a begin are ignored and fields that stay open are left out. On a level begins and ends alternate, so a begin's end is the
    next mark of its level; instructions and separators belong to the last begin of the level they are on. All is windows and
    groups within a part.
    """
    rows = _levels(tokens)
    mark = F.when(_fld("begin"), F.col("depth") + 1).when(_fld("end") & (F.col("depth") > 0), F.col("depth"))
    on_level = Window.partitionBy(*_KEY, "level").orderBy("place")
    marks = rows.withColumn("level", mark).where("level is not null")
    paired = marks.withColumns({"end": F.lead("place").over(on_level), "closes": F.lead("text").over(on_level)}).where("text = 'begin'")
    begins = paired.select(*_KEY, "place", "level", F.when(F.col("closes") == "end", F.col("end")).alias("end"))

    # what stands directly inside a field, and the begins one level deeper, look back to the last begin of the level
    inner = rows.where((F.col("depth") > 0) & (_fld("separate") | (F.col("kind") == "instr"))).select(*_KEY, "place", F.col("depth").alias("level"), F.when(F.col("kind") == "instr", "instr").otherwise("separate").alias("what"), "text", "in_del")
    none = F.lit(None)
    look = inner.unionByName(begins.select(*_KEY, "place", "level", F.lit("begin").alias("what"), none.cast("string").alias("text"), none.cast("boolean").alias("in_del")))
    look = look.unionByName(begins.where("level > 1").select(*_KEY, "place", (F.col("level") - 1).alias("level"), F.lit("child").alias("what"), none.cast("string").alias("text"), none.cast("boolean").alias("in_del")))
    owned = look.withColumn("owner", F.last(F.when(F.col("what") == "begin", F.col("place")), ignorenulls=True).over(on_level)).where("what <> 'begin'")

    child = owned.where("what = 'child'").select(*_KEY, F.col("place").alias("begin"), F.col("owner").alias("parent"))
    of_field = Window.partitionBy(*_KEY, "owner").orderBy("place")
    head = owned.where("what <> 'child'").withColumn("cut", F.min(F.when(F.col("what") == "separate", F.col("place"))).over(of_field))
    text = lambda cond: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(cond, F.struct("place", "text")))), lambda x: x["text"]), "")
    coded = (F.col("what") == "instr") & F.col("cut").isNull()
    parts = head.groupBy(*_KEY, F.col("owner").alias("begin")).agg(F.min(F.when(F.col("what") == "separate", F.col("place"))).alias("separate"), text(coded & ~F.col("in_del")).alias("code"), text(coded).alias("instruction"))

    out = begins.where("end is not null").withColumnRenamed("place", "begin").join(child, [*_KEY, "begin"], "left").join(parts, [*_KEY, "begin"], "left")
    out = out.withColumn("separate", F.when(F.col("separate") < F.col("end"), F.col("separate"))).fillna("", ["code", "instruction"])
    rank = F.row_number().over(Window.partitionBy(*_KEY).orderBy("end"))
    return out.select(*_KEY, "begin", "separate", "end", "level", "parent", F.coalesce(field_kind(F.col("instruction")), F.lit("")).alias("kind"), "code", "instruction", (F.col("end") - F.col("begin")).alias("members"), rank.alias("rank"))


def _gone(view: str) -> Column:
    return (F.col("in_del") | F.col("in_move_from")) if view == "accepted" else (F.col("in_ins") | F.col("in_move_to"))


def _around(tokens: DataFrame) -> DataFrame:
    """Tokens with ``fields``: the complete fields they are members of, innermost first, each (end, ins, del) with its begin's marks."""
    rows = _levels(tokens)
    on_level = Window.partitionBy(*_KEY, "level").orderBy("place", "what")
    is_begin, closes = _fld("begin"), _fld("end") & (F.col("depth") > 0)
    marks = rows.where(is_begin | closes).select(*_KEY, "place", F.when(is_begin, F.col("depth") + 1).otherwise(F.col("depth")).alias("level"), F.when(is_begin, 1).otherwise(0).alias("opens"), F.col("in_ins").alias("ins"), F.col("in_del").alias("del"))
    begins = marks.withColumns({"end": F.lead("place").over(Window.partitionBy(*_KEY, "level").orderBy("place")), "shut": F.lead("opens").over(Window.partitionBy(*_KEY, "level").orderBy("place"))}).where("opens = 1 and shut = 0")
    inside = rows.where("depth > 0").select(*_KEY, "place", F.explode(F.sequence(F.lit(1), F.col("depth"))).alias("level"))
    # at one place a begin opens a deeper level than its own token looks at, so the order of the two doesn't matter
    none = F.lit(None)
    look = inside.select(*_KEY, "place", "level", F.lit(1).alias("what"), none.cast("struct<end:int,ins:boolean,del:boolean>").alias("f"))
    look = look.unionByName(begins.select(*_KEY, "place", "level", F.lit(0).alias("what"), F.struct("end", "ins", "del").alias("f")))
    seen = look.withColumn("f", F.last("f", ignorenulls=True).over(on_level)).where("what = 1 and f.end >= place")
    found = seen.groupBy(*_KEY, "place").agg(F.array_sort(F.collect_list("f")).alias("fields"))
    return rows.join(found, [*_KEY, "place"], "left").withColumn("fields", F.coalesce("fields", F.array().cast("array<struct<end:int,ins:boolean,del:boolean>>"))).drop("depth", "place")


def _mended() -> Column:
    """(ins, del, stuck) of a token after the repair: its fields give it the marks of their begins, the innermost first; one that is
    struck can't be wrapped as inserted and stays."""
    start = F.struct(F.col("in_ins").alias("ins"), F.col("in_del").alias("del"), F.lit(0).alias("wraps"), F.lit(False).alias("stuck"))

    def wrap(s: Column, f: Column) -> Column:
        ins = f["ins"] & ~(s["ins"] | F.col("in_move_to"))
        struck = s["del"] | F.col("in_move_from")
        stuck = ins & struck
        add_del = f["del"] & ~struck & ~stuck
        return F.struct((s["ins"] | (ins & ~stuck)).alias("ins"), (s["del"] | add_del).alias("del"), (s["wraps"] + F.when((ins & ~stuck) | add_del, 1).otherwise(0)).alias("wraps"), (s["stuck"] | stuck).alias("stuck"))

    return F.aggregate("fields", start, wrap)


def fix_tracking(tokens: DataFrame) -> DataFrame:
    """Tokens with ``in_ins`` and ``in_del`` such that each tracked field resolves as a whole with its begin, and ``fixed`` (marks were
    added) and ``stuck`` (a mark is missing that can't be added). A second repair changes nothing."""
    rows = _around(tokens).withColumn("_m", _mended())
    return rows.select(*[F.col(f"_m.{c[3:]}").alias(c) if c in ("in_ins", "in_del") else F.col(c) for c in tokens.columns], (F.col("_m.wraps") > 0).alias("fixed"), F.col("_m.stuck").alias("stuck"))


def loose_runs(tokens: DataFrame) -> DataFrame:
    """doc, part, end (of the field), loose, stuck: fields some of whose tokens aren't resolved with a tracked begin, how many, and how
    many of them can't be wrapped."""
    each = _around(tokens).select(*_KEY, *FLAGS, F.explode("fields").alias("f"))
    need_ins = F.col("f.ins") & ~(F.col("in_ins") | F.col("in_move_to"))
    struck = F.col("in_del") | F.col("in_move_from")
    each = each.where(need_ins | (F.col("f.del") & ~struck)).withColumn("stuck", need_ins & struck)
    return each.groupBy(*_KEY, F.col("f.end").alias("end")).agg(F.count(F.lit(1)).alias("loose"), F.count_if("stuck").alias("stuck"))


def refused_documents(tokens: DataFrame) -> DataFrame:
    """doc, element: documents whose changes can't be resolved, since a table's geometry is among them."""
    return tokens.where("kind = 'geom'").groupBy("doc").agg(F.min("text").alias("element"))


def resolve_all(tokens: DataFrame, accept: bool) -> DataFrame:
    """Tokens after all changes are accepted or rejected, with ``status``: resolved, or refused (geometry changes; left as they were).

    What goes is dropped, but not the comment marks in it. What stays is plain: struck text is live again, property changes become
    ``props`` with the properties that hold, their record gone. A rejected paragraph mark joins its paragraph to the
    next one that keeps its mark; the last paragraph stays, unless nothing is left in it.
    """
    checked = tokens.join(refused_documents(tokens), "doc", "left")
    left = checked.where("element is not null").drop("element").withColumn("status", F.lit("refused"))
    rows = checked.where("element is null").drop("element")
    rows = rows.where(F.col("kind").isin(*COMMENT_MARKS, "p", "pmark") | ~_gone("accepted" if accept else "rejected"))
    if not accept:
        # a paragraph's number is that of the first one from it on whose mark isn't an insertion, or of the last one
        paras = rows.groupBy(*_KEY, "para").agg(F.max(F.when((F.col("kind") == "pmark") & F.col("in_ins"), 1).otherwise(0)).alias("joins"), F.count_if(~F.col("kind").isin("p", "pmark")).alias("n"))
        ahead = Window.partitionBy(*_KEY).orderBy(F.desc("para"))
        paras = paras.withColumn("_stop", (F.col("joins") == 0) | F.lag("para").over(ahead).isNull())
        paras = paras.withColumn("into", F.last(F.when(F.col("_stop"), F.col("para")), ignorenulls=True).over(ahead))
        total = F.sum("n").over(Window.partitionBy(*_KEY, "into"))
        paras = paras.withColumn("shell", (F.col("joins") == 1) & (F.col("into") == F.col("para")) & (total == 0))
        rows = rows.join(paras.select(*_KEY, "para", "into", "shell"), [*_KEY, "para"])
        rows = rows.where(~((F.col("kind") == "p") & ((F.col("into") != F.col("para")) | F.col("shell")))).withColumn("para", F.col("into")).drop("into", "shell")
    rows = rows.where("kind <> 'pmark'")
    props = F.get_json_object("text", "$.now" if accept else "$.prior")
    rows = rows.withColumn("text", F.when(F.col("kind") == "fmt", props).otherwise(F.col("text"))).withColumn("kind", F.when(F.col("kind") == "dt", "t").when(F.col("kind") == "fmt", "props").otherwise(F.col("kind")))
    plain = rows.withColumns({c: F.lit(False) for c in FLAGS}).withColumn("status", F.lit("resolved"))
    return plain.unionByName(left)


def edit_paragraphs(paragraphs: DataFrame, edits: DataFrame) -> DataFrame:
    """paragraphs(doc, para, text, style) with edits(doc, seq, op, para, blocks) in the order of seq -> doc, place, para, op, style, text.

    ``insert`` puts its blocks, ARRAY<(style, text)>, right behind the paragraph, so before what an earlier insert put there;
    ``delete`` strikes a paragraph's text. Both are tracked: op is keep, insert or delete. A row's place is its rank by
    (paragraph, inserted or not, latest edit first, block), so nothing is renumbered while edits are applied. Edits of paragraphs
    that aren't there change nothing (see ``refused_edits``).
    """
    struck = edits.where("op = 'delete'").select("doc", "para").distinct().withColumn("_struck", F.lit(True))
    old = paragraphs.join(struck, ["doc", "para"], "left").select("doc", "para", F.lit(0).alias("behind"), F.lit(0).alias("seq"), F.lit(0).alias("block"), F.when(F.col("_struck") & (F.col("text") != ""), "delete").otherwise("keep").alias("op"), "style", "text")
    new = edits.where("op = 'insert'").join(paragraphs.select("doc", "para"), ["doc", "para"], "left_semi").select("doc", "para", F.lit(1).alias("behind"), (-F.col("seq")).cast("int").alias("seq"), F.posexplode("blocks").alias("block", "b"))
    new = new.select("doc", "para", "behind", "seq", "block", F.lit("insert").alias("op"), "b.style", "b.text")
    place = F.row_number().over(Window.partitionBy("doc").orderBy("para", "behind", "seq", "block")) - 1
    return old.unionByName(new).withColumn("place", place).select("doc", "place", F.when(F.col("behind") == 0, F.col("para")).alias("para"), "op", "style", "text")


def place_edits(edits: DataFrame, found: DataFrame) -> DataFrame:
    """edits(doc, seq, op, anchor, blocks) with found(doc, anchor, n, para) of ``workflows.find_anchor`` -> with para and status: placed,
    not found, or not unique."""
    met = edits.join(found, ["doc", "anchor"], "left")
    return met.withColumn("status", F.when(F.coalesce("n", F.lit(0)) == 0, "not found").when(F.col("para").isNull(), "not unique").otherwise("placed")).drop("n")


def paragraphs_after(edited: DataFrame, accept: bool) -> DataFrame:
    """doc, place, text of edited paragraphs once the edits are accepted (struck text gone, its paragraph stays) or rejected."""
    rows = edited.where(F.lit(accept) | (F.col("op") != "insert"))
    return rows.select("doc", (F.row_number().over(Window.partitionBy("doc").orderBy("place")) - 1).alias("place"), F.when(F.lit(accept) & (F.col("op") == "delete"), "").otherwise(F.col("text")).alias("text"))
