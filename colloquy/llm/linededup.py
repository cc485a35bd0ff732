"""Line dedup with a suffix array over line-id sequences.

A document is a sequence of lines. Prefix doubling sorts its suffixes: the first level ranks a suffix by its first line,
the next by the pair of ranks at its place and one level's length on, or by the document's end there. Ranks come from a
range-sorted table of the distinct pairs with their counts, so a pair shared by very many suffixes is one row of it, and
each task adds its offset to what its own range holds. Suffixes whose rank is theirs alone share no longer prefix with
any other and drop out, those whose document ends keep their rank; doubling stops when none is left.

All suffixes of one rank are a longest-common-prefix interval: a run of lines that occurs more than once. The first of
an interval in document order is where its run comes from. For each suffix the longest interval that has an earlier first
gives the source, and comparing ranks level by level downwards, as far as both agree, gives the length of the common
prefix of the two: a maximal repeated run. Levels lie side by side as partitions of one table, so sources come from one
join whatever their number, and the driver plans no more for long runs than for short ones. In each document the later copies are deleted from left to right; of
copies that overlap, the one that begins first goes, and the next begins after it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from colloquy.llm._shared import scratch_path, spare, stored

_PLACE = ("doc", "copy", "at")


def _ranked(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """pairs (keys, n) with `new`, their rank: the number of suffixes whose key is smaller. No task sees more than one sum for each other one."""
    ordered = stored(pairs.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("part", F.spark_partition_id()), "line-pairs")
    sums = ordered.groupBy("part").agg(F.sum("n").alias("s"))
    offset = sums.select("part", (F.sum("s").over(Window.orderBy("part")) - F.col("s")).alias("offset"))
    within = F.sum("n").over(Window.partitionBy("part").orderBy(*keys).rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n")
    return ordered.join(F.broadcast(offset), "part").select(*keys, "n", (F.col("offset") + within).alias("new"))


def _line_key(line: Column) -> Column:
    """128 bits of a line: lines are the same when these are."""
    return F.unhex(F.md5(line))


def _lines(docs: DataFrame, id_col: str, text_col: str, key: Column | None = None) -> DataFrame:
    """(doc, copy, at, rest, line) for each line of each different document: its place, lines from there on, and key."""
    text = F.col(text_col)
    parts = docs.where(text.isNotNull()).select(F.col(id_col).alias("doc"), F.xxhash64(text).alias("copy"), F.split(text, "\n", -1).alias("all"))
    rows = parts.select("doc", "copy", F.size("all").alias("n"), F.posexplode(F.transform("all", key or _line_key)).alias("at", "line"))
    return rows.where("line IS NOT NULL").select("doc", "copy", "at", (F.col("n") - F.col("at")).alias("rest"), "line")


def suffix_ranks(docs: DataFrame, *, min_lines: int = 2, id_col: str = "doc_id", text_col: str = "text") -> tuple[list[int], DataFrame]:
    """Growing sizes, and (doc, copy, at, rest, rank, new, level) of suffixes that share sizes[level] lines, or all to their documents' ends, with another.

    Suffixes of one level and rank agree. `new` marks those that the level ranked; the others had ended before and keep their rank.
    """
    base = scratch_path(docs.sparkSession, "line-ranks")

    def written(df: DataFrame, n: int) -> DataFrame:
        df.write.parquet(f"{base}/level={n}")
        return df.sparkSession.read.schema(df.schema).parquet(f"{base}/level={n}")

    lines = _lines(docs, id_col, text_col)
    usual = lines.groupBy("line").agg(F.count("*").alias("n")).where("n > 1")
    named = _ranked(usual, ["line"]).select("line", F.col("new").alias("rank"))
    # rows of the same id and text are one document, so a line may be left with one place only
    level = written(lines.join(named, "line").select(*_PLACE, "rest", "rank", F.lit(True).alias("new")).distinct(), 0)
    schema, sizes, size = T.StructType([*level.schema.fields, T.StructField("level", T.IntegerType())]), [1], 1
    while True:
        step = min(size, min_lines - size) if size < min_lines else size
        further = Window.partitionBy("doc", "copy").orderBy("at").rangeBetween(step, step)
        ahead = level.withColumn("next", F.when(F.col("rest") > step, F.first("rank").over(further)).otherwise(-1))
        # a rank below -1 is one that an ended suffix has kept, by level
        ended = level.where(F.col("rest") < size).withColumns({"rank": F.when(F.col("new"), -2 - F.col("rank") * 64 - len(sizes)).otherwise(F.col("rank")), "new": F.lit(False)})
        pairs = ahead.where((F.col("rest") >= size) & F.col("next").isNotNull()).select(*_PLACE, "rest", "rank", "next")
        named = _ranked(pairs.groupBy("rank", "next").agg(F.count("*").alias("n")), ["rank", "next"]).where("n > 1")
        grown = pairs.join(named.select(F.col("rank").alias("_rank"), F.col("next").alias("_next"), F.col("new").alias("_new")), (F.col("rank") == F.col("_rank")) & (F.col("next") == F.col("_next")))
        level = written(grown.select(*_PLACE, "rest", F.col("_new").alias("rank"), F.lit(True).alias("new")).unionByName(ended), len(sizes))
        if level.where("new").isEmpty():
            return sizes, docs.sparkSession.read.schema(schema).parquet(base).where(F.col("level") < len(sizes))
        size += step
        sizes.append(size)


def repeated_runs(docs: DataFrame, *, min_lines: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, copy, at, len, source): the maximal run of min_lines lines or more at each place that occurs earlier, and where its source begins.

    The source is the first place of the longest interval of doubled length that has an earlier place. A source in the same
    document ends before its copy begins.
    """
    sizes, levels = suffix_ranks(docs, min_lines=min_lines, id_col=id_col, text_col=text_col)
    place = F.struct(*_PLACE)
    source = F.col("source")
    inside = F.col("doc").eqNullSafe(source["doc"]) & (F.col("copy") == source["copy"])
    ranked = levels.where(F.col("new") & (F.col("level") >= sum(size < min_lines for size in sizes)))
    first = ranked.groupBy("level", "rank").agg(F.min(place).alias("source"))
    agreed = F.least(F.element_at(F.array(*map(F.lit, sizes)), F.col("level") + 1), F.col("rest"))
    later = ranked.join(first, ["level", "rank"]).where((agreed >= min_lines) & (place > source) & (~inside | (source["at"] + agreed <= F.col("at"))))
    later = later.select(*_PLACE, "rest", F.struct("level", agreed.alias("len"), "source").alias("top"))
    runs = stored(later.groupBy(*_PLACE, "rest").agg(F.max("top").alias("top")).select(*_PLACE, "rest", "top.level", "top.len", "top.source"), "line-runs")
    own = ("doc", "copy", "at", "rest", "len", "source")
    open_, done = None, runs.where("level = 0 OR len = rest").select(*own)
    for n in reversed(range(len(sizes) - 1)):
        # further lines on which a run and its source agree, for runs whose own level is above this one
        begun = runs.where((F.col("level") == n + 1) & (F.col("len") < F.col("rest"))).select(*own)
        open_ = begun if open_ is None else open_.unionByName(begun)
        ranks = levels.where(F.col("level") == n).select(F.col("doc").alias("_doc"), F.col("copy").alias("_copy"), F.col("at").alias("_at"), F.col("rest").alias("_rest"), F.col("rank").alias("_rank"))
        further = F.col("doc").eqNullSafe(F.col("_doc")) & (F.col("copy") == F.col("_copy")) & (F.col("at") + F.col("len") == F.col("_at"))
        here = open_.join(ranks, further, "left").select(*own, F.col("_rest").alias("left"), F.col("_rank").alias("mine"))
        same = source["doc"].eqNullSafe(F.col("_doc")) & (source["copy"] == F.col("_copy")) & (source["at"] + F.col("len") == F.col("_at")) & (F.col("mine") == F.col("_rank"))
        more = F.when(F.col("_rank").isNull(), 0).otherwise(F.least(F.lit(sizes[n]), F.col("left")))
        open_ = stored(here.join(ranks, same, "left").withColumn("len", F.col("len") + more).select(*own), "line-runs")
    runs = done if open_ is None else done.unionByName(open_)
    length = F.when(inside, F.least(F.col("len"), F.col("at") - source["at"])).otherwise(F.col("len"))
    return runs.select(*_PLACE, length.alias("len"), "source")


def _single_lines(docs: DataFrame, min_words: int, id_col: str, text_col: str) -> DataFrame:
    """(doc, copy, at, len): later copies of lines of min_words words or more."""
    key = lambda x: F.when(F.regexp_count(x, F.lit(r"\S+")) >= min_words, _line_key(x))
    lines = _lines(docs, id_col, text_col, key)
    place = F.struct(*_PLACE)
    first = lines.groupBy("line").agg(F.count("*").alias("n"), F.min(place).alias("source")).where("n > 1")
    return lines.join(first, "line").where(place > F.col("source")).select(*_PLACE, F.lit(1).alias("len")).distinct()


def dedup_lines(docs: DataFrame, *, min_lines: int = 2, min_words: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with `n_lines`, `n_removed` and the text less its later copies of maximal repeated runs of min_lines lines or more.

    Lines are what lies between line feeds. In each document, from left to right: where a run of repeated_runs() begins
    that does not overlap the one deleted before it, its lines go. A run's first occurrence, by id (nulls first) and place,
    stays whole; a run that overlaps its own source counts as far as the two do not overlap, so of `a a a a` two lines
    stay. Every row comes back: a text all of whose lines go is empty, a null text stays null and has no lines. Rows with
    the same id and text are the same document: they are no copies of each other and lose the same lines. Rows with one id
    and different texts are different documents, in the order of their texts' hashes. An empty table gives an empty one.
    Ids may be of any type that can be ordered. Columns named n_lines or n_removed are replaced, others may have any name.
    With min_words, later copies of single lines of that many words or more go too, whatever stands around them.
    """
    runs = repeated_runs(docs, min_lines=min_lines, id_col=id_col, text_col=text_col)
    run = F.struct("at", "len")
    none = F.array(F.struct(F.lit(0).alias("at"), F.lit(0).alias("len")))
    parsed = F.aggregate(F.array_sort(F.collect_list(run)), none, lambda kept, x: F.when(x["at"] >= F.element_at(kept, -1)["at"] + F.element_at(kept, -1)["len"], F.concat(kept, F.array(x))).otherwise(kept))
    gone = runs.groupBy("doc", "copy").agg(parsed.alias("runs"))
    if min_words is not None:
        single = _single_lines(docs, min_words, id_col, text_col).groupBy("doc", "copy").agg(F.collect_list(run).alias("runs"))
        gone = gone.unionByName(single).groupBy("doc", "copy").agg(F.flatten(F.collect_list("runs")).alias("runs"))
    own = ("n_lines", "n_removed")
    all_, doc, copy, lost, key, text_hash = spare(docs.columns, "lines", "doc", "copy", "gone", "key", "hash")
    numbers = F.array_distinct(F.flatten(F.transform(F.filter("runs", lambda x: x["len"] > 0), lambda x: F.sequence(x["at"], x["at"] + x["len"] - 1))))
    gone = gone.select(F.col("doc").alias(doc), F.col("copy").alias(copy), numbers.alias(lost))
    rows = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in own], F.col(id_col).alias(key), F.xxhash64(text_col).alias(text_hash))
    # texts meet their lost lines by a merge at every size of the table
    rows = rows.join(gone.hint("merge"), F.col(key).eqNullSafe(F.col(doc)) & (F.col(text_hash) == F.col(copy)), "left").withColumn(all_, F.split(text_col, "\n", -1))
    kept = F.transform(F.array_except(F.sequence(F.lit(0), F.size(all_) - 1), lost), lambda i: F.col(all_)[i])
    none_gone = F.col(lost).isNull() | F.col(text_col).isNull()
    out = rows.withColumns({
        "n_lines": F.when(F.col(text_col).isNull(), 0).otherwise(F.size(all_)).cast("long"), "n_removed": F.when(none_gone, 0).otherwise(F.size(lost)).cast("long"),
        text_col: F.when(none_gone, F.col(text_col)).otherwise(F.array_join(kept, "\n")),
    })
    return out.select(*[F.col(f"`{c}`") for c in docs.columns if c not in own], *own)
