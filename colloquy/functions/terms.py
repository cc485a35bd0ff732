"""Terms matched by a table: lexicon (category, term, kind), of any size, against texts, in joins.

kind `word`: the term stands alone, no letter, digit or underscore on either side. kind `part`: it may lie anywhere. Case
does not matter. Occurrences of a term do not overlap, counted from the left. Single words are looked up among a text's words;
other terms are looked up by their first character among the text's windows, each as long as the longest term.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.functions import text as tx
from colloquy.functions.lexicons import CJK, Lexicon

#: A lexicon of no more terms than this is sent to every executor; a larger one is joined by shuffles.
BROADCAST_TERMS = 200_000
#: Characters of a text that are cut into windows at a time.
PIECE = 4096

_WORD = r"[\p{L}\p{N}_]"
LEXICON = "category string, term string, kind string"


def kind_of(term: Column) -> Column:
    """`part` for terms with a CJK character, `word` for others: how topic terms are meant."""
    return F.when(term.rlike(CJK), "part").otherwise("word")


def read_lexicon(spark: SparkSession, path: str) -> DataFrame:
    """A lexicon from a CSV file with a header, or from JSON lines or Parquet: category, term and, if there, kind."""
    read = spark.read.option("header", "true").csv if path.endswith((".csv", ".csv.gz")) else spark.read.parquet if path.endswith(".parquet") else spark.read.json
    return checked(read(path))


def from_domains(spark: SparkSession, lx: Lexicon) -> DataFrame:
    """The topic domains of a Lexicon as a table."""
    rows = [(name, term) for name, terms in lx.domains.items() for term in terms]
    return checked(spark.createDataFrame(rows, "category string, term string"))


def checked(lexicon: DataFrame) -> DataFrame:
    """(category, term, kind) in lower case, each once, without null or blank terms; a missing kind follows from the term."""
    term = F.lower(tx.strip(F.col("term")))
    kind = F.coalesce(F.col("kind"), kind_of(term)) if "kind" in lexicon.columns else kind_of(term)
    return lexicon.select(F.col("category").cast("string").alias("category"), term.alias("term"), kind.alias("kind")).where("term <> '' AND category IS NOT NULL").distinct()


def _sent(lexicon: DataFrame, small: bool) -> DataFrame:
    return F.broadcast(lexicon) if small else lexicon


def _windows(text: Column, width: int) -> Column:
    """array<struct<at, before, w>>: each place of a text, the character before it and up to width characters from it on."""
    pieces = F.regexp_extract_all(text, F.lit(f"(?s)(.{{1,{PIECE}}})"), 1)
    last = lambda c: F.when(c.isNull(), " ").otherwise(F.substring(c, -1, 1))
    both = F.transform(pieces, lambda p, k: F.struct(p.alias("p"), k.alias("k"), last(F.get(pieces, k - 1)).alias("before"), F.coalesce(F.substr(F.get(pieces, k + 1), F.lit(1), F.lit(width)), F.lit("")).alias("more")))
    windows = lambda x: F.slice(F.regexp_extract_all(F.concat(x["before"], x["p"], x["more"]), F.lit(f"(?s)(?=(.{{1,{width + 1}}}))."), 1), F.lit(1), F.length(x["p"]))
    return F.flatten(F.transform(both, lambda x: F.transform(windows(x), lambda w, i: F.struct((x["k"] * PIECE + i).alias("at"), F.substr(w, F.lit(1), F.lit(1)).alias("before"), F.substr(w, F.lit(2), F.lit(width)).alias("w")))))


def _apart(ends: Column) -> Column:
    """How many of the occurrences do not overlap, from the left: ends is an array of (at, length)."""
    start = F.struct(F.lit(-1).alias("end"), F.lit(0).alias("n"))
    step = lambda a, x: F.when(x["at"] >= a["end"], F.struct((x["at"] + x["size"]).alias("end"), (a["n"] + 1).alias("n"))).otherwise(a)
    return F.aggregate(F.array_sort(ends), start, step, lambda a: a["n"])


def occurrences(texts: DataFrame, lexicon: DataFrame, *, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """(id, category, term, hits) of every term that a text has. Null texts and ids have none; rows of one id count as one text each."""
    own = texts.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.lower(tx.text_of(F.col(text_col))).alias("t"))
    lexicon = checked(lexicon)
    n, width = lexicon.agg(F.count("*"), F.max(F.length("term"))).first()
    small, one = n <= BROADCAST_TERMS, F.col("term").rlike(f"^{_WORD}+$")
    words = own.select("id", F.explode(F.regexp_extract_all("t", F.lit(f"({_WORD}+)"), 1)).alias("term"))
    # only words of the lexicon are counted, and so shuffled
    single = words.join(_sent(lexicon.where((F.col("kind") == "word") & one).drop("kind"), small), "term").groupBy("id", "category", "term").agg(F.count("*").cast("int").alias("hits"))
    others = lexicon.where((F.col("kind") == "part") | ~one).withColumns({"first": F.substr("term", F.lit(1), F.lit(1)), "size": F.length("term")})
    at = own.withColumn("row", F.monotonically_increasing_id()).select("id", "row", F.explode(_windows(F.col("t"), (width or 1) + 1)).alias("x")).select("id", "row", "x.*")
    alone = ~F.col("before").rlike(_WORD) & ~F.substr("w", F.col("size") + 1, F.lit(1)).rlike(_WORD)
    met = at.join(_sent(others, small), (F.substr("w", F.lit(1), F.lit(1)) == F.col("first")) & F.col("w").startswith(F.col("term")) & ((F.col("kind") == "part") | alone))
    counted = met.groupBy("id", "row", "category", "term").agg(_apart(F.collect_list(F.struct("at", "size"))).alias("hits"))
    return single.unionByName(counted.select("id", "category", "term", "hits"))


def category_counts(texts: DataFrame, lexicon: DataFrame, *, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """(id, category, hits): what a text's terms of each category add up to, categories without any left out."""
    found = occurrences(texts, lexicon, id_col=id_col, text_col=text_col)
    return found.groupBy("id", "category").agg(F.sum("hits").cast("int").alias("hits"))


def category_maps(texts: DataFrame, lexicon: DataFrame, *, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """(id, counts): the same as one map for each id that has any."""
    own = category_counts(texts, lexicon, id_col=id_col, text_col=text_col)
    return own.groupBy("id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("category", "hits")))).alias("counts"))
