"""N-Triples as line-split text: reading and writing in parallel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.plans.layout import laid_out
from loomgraph.sources.blank import graph_label, named, scoped

#: Subject and predicate, up to the object.
_HEAD = r"^\s*(<[^>\s]*>|_:\S+)\s+(<[^>\s]*>)\s+(?=\S)"
#: What may follow an object: the dot and a comment, which has no quotes. So it all comes after the last quote of a line.
_END = r'(?s)^(.*?)\s*\.\s*(?:#[^"]*)?$'
_STRING = "^^<http://www.w3.org/2001/XMLSchema#string>"
_NODE = r"^(<[^>\s]*>|_:\S+)$"
_TAIL = r"^(@[A-Za-z0-9-]+|\^\^<[^>\s]*>)?$"


def _literal(term: Column) -> Column:
    """Whether a term is a whole literal: its quotes inside are escaped."""
    bare = F.replace(F.replace(term, F.lit("\\\\"), F.lit("")), F.lit('\\"'), F.lit(""))
    end = F.locate('"', bare, 2)
    return bare.startswith('"') & (end > 0) & F.substr(bare, end + 1).rlike(_TAIL)


def _split(lines: DataFrame) -> DataFrame:
    """``lines`` (value, ...) with (s, p, o), o with xsd:string literals in the plain form; all null in a line that is no triple. Literals may be whole texts, so
    patterns look only at what is before and after them."""
    col = F.col
    parts = lines.withColumn("_head", F.regexp_extract("value", _HEAD, 0)).withColumn("_rest", F.substr("value", F.length("_head") + 1))
    parts = parts.withColumn("_tail", F.substring_index("_rest", '"', -1))
    parts = parts.withColumn("_o", F.when((col("_head") != "") & col("_tail").rlike(_END), F.concat(F.substr("_rest", F.lit(1), F.length("_rest") - F.length("_tail")), F.regexp_extract("_tail", _END, 1))))
    parts = parts.withColumn("_o", F.when(F.when(col("_o").startswith('"'), _literal(col("_o"))).otherwise(col("_o").rlike(_NODE)), col("_o")))
    plain = F.when(col("_o").endswith(_STRING), F.substr("_o", F.lit(1), F.length("_o") - len(_STRING))).otherwise(col("_o"))
    ends = F.split(F.trim(F.when(col("_o").isNotNull(), F.regexp_replace("_head", r"\s+", " "))), " ")
    return _once(parts.select(*lines.columns, ends[0].alias("s"), ends[1].alias("p"), plain.alias("o")))


def _once(df: DataFrame) -> DataFrame:
    """The same rows from a generator, which no filter is moved below: else each filter of a later step, at each use, would work out all its columns again."""
    return df.select(F.inline(F.array(F.struct(*df.columns))))


def line_triples(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(source, s, p, o, error) of N-Triples files; a line that is no triple, blank or comment has only an error. Blank nodes are named by their file,
    but for those of a graph that was written in several parts (``blank.SCOPED``), which are the graph's."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("source")).filter(~F.col("value").rlike(r"^\s*(#.*)?$"))
    error = F.when(F.col("s").isNull(), F.concat(F.lit("not N-Triples: "), F.substr("value", F.lit(1), F.lit(250))))
    return _once(_split(lines).select("source", named(F.col("s"), F.col("source")).alias("s"), "p", named(F.col("o"), F.col("source")).alias("o"), error.alias("error")))


def read_ntriples(spark: SparkSession, path: str | list[str], strict: bool = True) -> DataFrame:
    """The set of triples of N-Triples files, blank nodes as in ``line_triples``. Lines that are no triple, blank or comment raise, or drop out unless ``strict``."""
    rows = line_triples(spark, path)
    fine = F.when(F.col("error").isNotNull(), F.raise_error(F.col("error")).cast("boolean")).otherwise(True) if strict else F.col("error").isNull()
    return rows.filter(fine).select("s", "p", "o").distinct()


def load_ntriples(spark: SparkSession, path: str | list[str], strict: bool = True) -> DataFrame:
    """``read_ntriples`` for several uses: the lines are parsed once, here, and the triples lie by predicate, so each pattern reads those of its own."""
    return laid_out(read_ntriples(spark, path, strict))


def write_ntriples(triples: DataFrame, path: str) -> None:
    """Triples as N-Triples; those with a literal subject, which the format lacks, are left out. Blank nodes are the graph's in all files."""
    graph = graph_label()
    triples.filter("not startswith(s, '\"')").select(F.concat_ws(" ", scoped(F.col("s"), graph), "p", scoped(F.col("o"), graph), F.lit("."))).write.text(path)
