"""Corpus and table files: reading and writing through Spark's own sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StringType, StructType

FORMATS = {"ttt": "tt", "tt": "tt", "t": "tt", "brown": "brown", "lob": "lob", "xml": "xml", "parquet": "parquet", "bin": "parquet"}


def format_of(path: str) -> str:
    """The format of ``fmt:path`` or of a path's ending; TT where neither is known."""
    head = path.split(":", 1)[0]
    return head if head in set(FORMATS.values()) else FORMATS.get(path.rsplit(".", 1)[-1].lower(), "tt")


def read_corpus(spark: SparkSession, path: str | list[str], fmt: str | None = None) -> DataFrame:
    """(file, sid, toks): sentences of (text, tag, details) tokens in any of the formats; several paths if the format is given."""
    fmt = fmt or format_of(path)
    path = path.removeprefix(f"{fmt}:") if isinstance(path, str) else path
    readers = {"tt": read_tt, "brown": lambda s, p: read_separated(s, p, "/"), "lob": lambda s, p: read_separated(s, p, "_", ignore="^"), "xml": read_xml, "parquet": lambda s, p: s.read.parquet(*([p] if isinstance(p, str) else p))}
    return readers[fmt](spark, path)


def numbered_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, split, at, value): the lines of text files; a file's lines are in the order of (split, at).

    A split is where Spark begins to read a part of a file, so large files are
    read by many tasks.
    """
    place = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split")]
    return spark.read.text(path).select(*place, F.monotonically_increasing_id().alias("at"), "value")


def read_tt(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """One token a line, fields between tabs, empty lines between sentences, lines that start with %% ignored.

    Sentences are numbered by the starts in their own split and the number of
    starts in the splits before it; one may go on over splits.
    """
    lines = numbered_lines(spark, path).where(~F.col("value").startswith("%%")).withColumn("blank", ~F.col("value").rlike(r"\S"))
    in_split = Window.partitionBy("file", "split").orderBy("at")
    marked = lines.withColumn("start", (~F.col("blank") & F.coalesce(F.lag("blank").over(in_split), F.lit(True))).cast("long"))
    splits = marked.groupBy("file", "split").agg(F.sum("start").alias("starts"), F.min_by("blank", "at").alias("first"), F.max_by("blank", "at").alias("last"))
    in_file = Window.partitionBy("file").orderBy("split")  # a row for each split
    goes_on = (~F.col("first") & ~F.coalesce(F.lag("last").over(in_file), F.lit(True))).cast("long")
    splits = splits.withColumn("on", goes_on).withColumn("before", F.sum(F.col("starts") - F.col("on")).over(in_file) - F.col("starts"))
    placed = marked.withColumn("start", F.sum("start").over(in_split)).where("not blank").join(splits.select("file", "split", "before"), ["file", "split"])
    fields = F.transform(F.split("value", "\t"), lambda y: F.trim(y))
    token = F.struct(F.get(fields, F.lit(0)).alias("text"), F.get(fields, F.lit(1)).alias("tag"), F.slice(fields, 3, F.greatest(F.size(fields) - 2, F.lit(0))).alias("details"))
    each = placed.select("file", (F.col("before") + F.col("start")).alias("sid"), F.struct("split", "at", token.alias("token")).alias("x"))
    return each.groupBy("file", "sid").agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["token"]).alias("toks"))


def write_tt(sents: DataFrame, path: str, by: list[str]) -> None:
    """Sentences (by…, toks) as TT text, in the order of ``by`` within each file; missing fields are left out."""
    line = lambda t: F.array_join(F.filter(F.concat(F.array(t["text"], t["tag"]), t["details"]), lambda x: x.isNotNull()), "\t")
    text = F.concat(F.array_join(F.transform("toks", line), "\n"), F.lit("\n"))
    sents.sortWithinPartitions(*by).select(text.alias("value")).write.text(path)


def read_separated(spark: SparkSession, path: str, separator: str = "/", ignore: str = "") -> DataFrame:
    """One sentence a line, tokens between white space, ``text<separator>tag`` cut at the last separator."""
    lines = spark.read.text(path).select(F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("sid"), F.split(F.trim("value"), r"\s+").alias("raw"))
    mark = "\\" + separator
    token = lambda t: F.struct(F.regexp_extract(t, f"^(.*?)(?:{mark}([^{mark}]*))?$", 1).alias("text"), F.when(t.contains(separator), F.regexp_extract(t, f"{mark}([^{mark}]*)$", 1)).alias("tag"), F.array().cast("array<string>").alias("details"))
    kept = F.filter("raw", lambda t: (F.length(t) > 0) & (t != F.lit(ignore)))
    return lines.select("file", "sid", F.transform(kept, token).alias("toks")).where(F.size("toks") > 0)


def write_separated(sents: DataFrame, path: str, separator: str = "/") -> None:
    text = F.array_join(F.transform("toks", lambda t: F.concat_ws(separator, t["text"], t["tag"])), " ")
    sents.select(text.alias("value")).write.text(path)


def read_xml(spark: SparkSession, path: str, sentence: str = "s", token: str = "t") -> DataFrame:
    """Sentence elements that hold token elements with the text and a ``tag`` attribute."""
    schema = f"{token} array<struct<_VALUE:string,_tag:string>>"
    rows = spark.read.format("xml").option("rowTag", sentence).schema(schema).load(path)
    toks = F.transform(token, lambda t: F.struct(t["_VALUE"].alias("text"), t["_tag"].alias("tag"), F.array().cast("array<string>").alias("details")))
    return rows.select(F.lit(path).alias("file"), F.monotonically_increasing_id().alias("sid"), toks.alias("toks"))


def _followed(value: Column, kind: DataType, steps: list[str]) -> tuple[Column, DataType]:
    """What a path leads to from a value: child elements by name, attributes by ``@name``, ``.`` for the text; arrays on the way are flattened, what isn't there is null."""
    if isinstance(kind, ArrayType):
        inner = _followed(F.lit(None), kind.elementType, steps)[1]
        each = F.transform(value, lambda x: _followed(x, kind.elementType, steps)[0])
        return (F.flatten(each), inner) if isinstance(inner, ArrayType) else (each, ArrayType(inner))
    if not steps:
        return value, kind
    name = {".": "_VALUE"}.get(steps[0], steps[0].replace("@", "_"))
    if isinstance(kind, StructType) and name in kind.fieldNames():
        return _followed(value.getField(name), kind[name].dataType, steps[1:])
    return (value if steps == ["."] and not isinstance(kind, StructType) else F.lit(None).cast("string")), StringType()


def read_xml_by_path(spark: SparkSession, path: str, sentence: str, tokens: str, text: str = ".", tag: str | None = None, details: str | None = None) -> DataFrame:
    """(file, sid, toks) of ``sentence`` elements anywhere in the files.

    ``tokens`` is the path of the tokens below a sentence, such as ``w`` or
    ``phrase/w``; ``text``, ``tag`` and ``details`` are paths below a token, such as
    ``.``, ``@pos`` or ``form/@text``.  Tokens come out as structs (text, tag,
    details); a path to several elements gives the first, but all as details.
    """
    rows = spark.read.format("xml").option("rowTag", sentence).option("inferSchema", "false").load(path)
    found, kind = _followed(F.struct(*rows.columns), rows.schema, tokens.split("/"))
    if not isinstance(kind, ArrayType):
        found, kind = F.when(found.isNotNull(), F.array(found)), ArrayType(kind)

    def one(token: Column, at: str | None) -> Column:
        if at is None:
            return F.lit(None).cast("string")
        value, inner = _followed(token, kind.elementType, at.split("/"))
        return (F.get(value, F.lit(0)) if isinstance(inner, ArrayType) else value).cast("string")

    def every(token: Column, at: str | None) -> Column:
        if at is None:
            return F.array().cast("array<string>")
        value, inner = _followed(token, kind.elementType, at.split("/"))
        return F.coalesce((value if isinstance(inner, ArrayType) else F.array_compact(F.array(value))).cast("array<string>"), F.array().cast("array<string>"))

    toks = F.transform(found, lambda t: F.struct(one(t, text).alias("text"), one(t, tag).alias("tag"), every(t, details).alias("details")))
    return rows.select(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("sid"), F.coalesce(toks, F.array().cast("array<struct<text:string,tag:string,details:array<string>>>")).alias("toks"))


def write_xml(sents: DataFrame, path: str, sentence: str = "s", token: str = "t") -> None:
    """Sentences (toks) as elements whose tokens have the text and a ``tag`` attribute, as ``read_xml`` reads them."""
    toks = F.transform("toks", lambda t: F.struct(t["text"].alias("_VALUE"), t["tag"].alias("_tag")))
    sents.select(toks.alias(token)).write.format("xml").option("rootTag", "document").option("rowTag", sentence).save(path)


def write_files(sents: DataFrame, path: str, n: int) -> None:
    """A corpus over n Parquet files."""
    sents.repartition(n).write.parquet(path)


def read_file_list(spark: SparkSession, path: str, fmt: str = "tt", select: str | None = None, ignore: str | None = None) -> DataFrame:
    """(file, sid, toks) of all corpora that a list file names, one path a line, empty lines and those that start with %% left out.

    Of these, paths that ``select`` is found in are read (all, if it is None), but not those that ``ignore`` is found in.
    """
    lines = F.trim("value")
    named = spark.read.text(path).select(lines.alias("path")).where((F.col("path") != "") & ~F.col("path").startswith("%%"))
    named = named if select is None else named.where(F.col("path").rlike(select))
    named = named if ignore is None else named.where(~F.col("path").rlike(ignore))
    paths = sorted({r["path"] for r in named.collect()})  # names of files, which Spark's own list of inputs holds as well
    if not paths:
        return spark.createDataFrame([], "file string, sid long, toks array<struct<text:string,tag:string,details:array<string>>>")
    return read_corpus(spark, paths, fmt)


def read_table(spark: SparkSession, path: str, separator: str = "\t") -> DataFrame:
    """A table of text whose header starts with ``#``; ``3(name)`` and ``name_3`` titles lose their number, repeated names get ``(k)``."""
    head = spark.read.text(path).where(F.col("value").startswith("#")).first()
    import re

    titles = [re.sub(r"^\d+\((.*)\)$|^(.*)_\d+$", lambda m: m[1] or m[2] or "", t) for t in re.split(separator, head["value"].lstrip("#").strip())]
    names = [t if titles[:i].count(t) == 0 else f"{t}({titles[:i].count(t) + 1})" for i, t in enumerate(titles)]
    rows = spark.read.text(path).where(~F.col("value").startswith("#") & F.col("value").rlike(r"\S"))
    cells = F.split("value", separator)
    return rows.select(*[F.get(cells, F.lit(i)).alias(n) for i, n in enumerate(names)])


def write_table(df: DataFrame, path: str) -> None:
    """A tab-separated table with a header; null is written as 0."""
    df.select(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("0")).alias(c) for c in df.columns]).write.option("sep", "\t").option("header", True).csv(path)


def write_distribution(dist: DataFrame, path: str, event: str = "w") -> None:
    """``event<tab>weight`` lines by falling weight."""
    dist.orderBy(F.desc("f"), event).select(F.concat_ws("\t", event, F.col("f").cast("string")).alias("value")).write.text(path)


def read_distribution(spark: SparkSession, path: str, event: str = "w") -> DataFrame:
    """(w, f) from lines of an event and, after the last white space, its weight."""
    return spark.read.text(path).where(F.col("value").rlike(r"\S")).select(F.regexp_extract("value", r"^(.*?)\s+(\S+)$", 1).alias(event), F.regexp_extract("value", r"^(.*?)\s+(\S+)$", 2).cast("double").alias("f"))


def write_lexicon(lex: DataFrame, path: str) -> None:
    """``word<tab>total<tab>tag<tab>count…`` lines of (w, tag, f)."""
    rows = lex.groupBy("w").agg(F.sum("f").alias("all"), F.array_sort(F.collect_list(F.struct("tag", "f"))).alias("tags"))
    rows.select(F.concat_ws("\t", "w", F.col("all").cast("string"), F.array_join(F.transform("tags", lambda x: F.concat_ws("\t", x["tag"], x["f"].cast("string"))), "\t")).alias("value")).write.text(path)


def read_lexicon(spark: SparkSession, path: str) -> DataFrame:
    """(w, tag, f); the totals in the file are not trusted."""
    cells = spark.read.text(path).where(F.col("value").rlike(r"\S")).select(F.split("value", "\t").alias("c"))
    pairs = F.transform(F.sequence(F.lit(2), F.size("c") - 2, F.lit(2)), lambda i: F.struct(F.get("c", i).alias("tag"), F.get("c", i + 1).cast("double").alias("f")))
    return cells.where(F.size("c") >= 4).select(F.get("c", F.lit(0)).alias("w"), F.explode(pairs).alias("p")).select("w", "p.tag", "p.f")


def read_ngrams(spark: SparkSession, path: str, n: int) -> DataFrame:
    """(w1..wn, f) from a file whose empty fields repeat the row above; a file is filled down on its own."""
    lines = numbered_lines(spark, path).where(F.col("value").rlike(r"\S") & ~F.col("value").startswith("%%")).withColumn("c", F.split("value", "\t"))
    cell = lambda i: F.when(F.get("c", F.lit(i)) != "", F.get("c", F.lit(i)))
    # What is filled down comes from the split itself, or from the last one before it that has such a cell.
    in_split, in_file = Window.partitionBy("file", "split").orderBy("at"), Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    ends = lines.groupBy("file", "split").agg(*[F.max_by(cell(i), F.when(cell(i).isNotNull(), F.col("at"))).alias(f"e{i}") for i in range(n)])
    ends = ends.select("file", "split", *[F.last(f"e{i}", ignorenulls=True).over(in_file).alias(f"e{i}") for i in range(n)])
    filled = lines.select("file", "split", "c", *[F.last(cell(i), ignorenulls=True).over(in_split).alias(f"o{i}") for i in range(n)])
    return filled.join(ends, ["file", "split"]).select(*[F.coalesce(f"o{i}", f"e{i}").alias(f"w{i + 1}") for i in range(n)], F.get("c", F.lit(n)).cast("double").alias("f"))


def write_ngrams(grams: DataFrame, path: str, n: int) -> None:
    """The same, each partition sorted and compressed against the row above."""
    names = [f"w{i + 1}" for i in range(n)]
    rows = grams.repartitionByRange(*names).withColumn("_p", F.spark_partition_id())
    order = Window.partitionBy("_p").orderBy(*names)
    same, cells = F.lit(True), []
    for c in names:
        same = same & F.coalesce(F.lag(c).over(order) == F.col(c), F.lit(False))
        cells.append(F.when(same, F.lit("")).otherwise(F.col(c)))
    rows.select(F.concat_ws("\t", *cells, F.col("f").cast("string")).alias("value")).write.text(path)


def read_variables(spark: SparkSession, path: str) -> DataFrame:
    """(name, op, value) of ``name op= value`` lines; a backslash at a line's end continues it, # starts a comment."""
    files = spark.read.text(path, wholetext=True).select(F.explode(F.split(F.regexp_replace("value", r"[ \t]*\\\n[ \t]*", " "), "\n")).alias("line"))
    pattern = r"^\s*([\w.\-]+)\s*(\?=|:=|\+=|=)\s*([^#]*?)\s*(?:#.*)?$"
    return files.where(F.col("line").rlike(pattern)).select(*[F.regexp_extract("line", pattern, i + 1).alias(c) for i, c in enumerate(("name", "op", "value"))])


def write_map(pairs: DataFrame, path: str) -> None:
    """Rows (k, v) as lines of a key, a tab and a value."""
    pairs.select(F.concat_ws("\t", F.col("k").cast("string"), F.col("v").cast("string")).alias("value")).write.text(path)


def read_map(spark: SparkSession, path: str) -> DataFrame:
    """(k, v); a line without a tab has no value, empty lines and those that start with %% are ignored."""
    lines = spark.read.text(path).where(F.col("value").rlike(r"\S") & ~F.col("value").startswith("%%"))
    cells = F.split("value", "\t", 2)
    return lines.select(F.get(cells, F.lit(0)).alias("k"), F.get(cells, F.lit(1)).alias("v"))


def write_set(rows: DataFrame, column: str, path: str) -> None:
    """The different values of a column, one a line."""
    rows.select(F.col(column).cast("string").alias("value")).where("value is not null").distinct().write.text(path)


def read_set(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).where(F.col("value").rlike(r"\S")).select(F.col("value").alias("k")).distinct()


def write_enum(enum: DataFrame, path: str) -> None:
    """A dictionary (sym, id) as lines of an id, a tab and a symbol."""
    write_map(enum.select(F.col("id").alias("k"), F.col("sym").alias("v")), path)


def read_enum(spark: SparkSession, path: str) -> DataFrame:
    """(sym, id); where an id or a symbol comes twice, the least of the other stays."""
    pairs = read_map(spark, path).select(F.col("v").alias("sym"), F.col("k").cast("long").alias("id")).where("sym is not null and id is not null")
    return pairs.groupBy("sym").agg(F.min("id").alias("id")).groupBy("id").agg(F.min("sym").alias("sym")).select("sym", "id")


def write_hmm(lex: DataFrame, moves: DataFrame, path: str) -> None:
    """A hidden Markov model as its counts: a lexicon (w, tag, f) and bigrams (t1, t2, f) of tags."""
    write_lexicon(lex, f"{path}.lex")
    write_ngrams(moves.select(F.col("t1").alias("w1"), F.col("t2").alias("w2"), "f"), f"{path}.123", 2)


def read_hmm(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """((w, tag, f), (t1, t2, f)) of ``path``.lex and ``path``.123."""
    moves = read_ngrams(spark, f"{path}.123", 2)
    return read_lexicon(spark, f"{path}.lex"), moves.select(F.col("w1").alias("t1"), F.col("w2").alias("t2"), "f")


def write_matrix(cells: DataFrame, path: str, row: str, column: str, value: str, columns: list[str]) -> None:
    """Cells as a dense table: a line for each row with its name and a value, 0 where there is none, for each of the named columns; a header first.

    The header is a file of its own, ``path``/header.
    """
    spark = cells.sparkSession
    spark.createDataFrame([("\t".join([row, *columns]),)], "value string").coalesce(1).write.text(f"{path}/header")
    named = cells.select(F.col(row).alias("_row"), F.col(column).alias("_column"), F.col(value).alias("_value"))
    wide = named.groupBy("_row").pivot("_column", columns).agg(F.first("_value"))
    line = F.concat_ws("\t", F.col("_row").cast("string"), *[F.coalesce(F.col(f"`{c}`"), F.lit(0)).cast("string") for c in columns])
    wide.select(line.alias("value")).write.text(f"{path}/rows")


def read_matrix(spark: SparkSession, path: str) -> DataFrame:
    """(row, column, value) of the cells of a dense table that are not 0."""
    names = spark.read.text(f"{path}/header").first()["value"].split("\t")[1:]
    cells = spark.read.text(f"{path}/rows").select(F.split("value", "\t").alias("c"))
    each = cells.select(F.get("c", F.lit(0)).alias("row"), F.posexplode(F.slice("c", 2, len(names))).alias("at", "x"))
    return each.select("row", F.get(F.lit(names), F.col("at")).alias("column"), F.col("x").cast("double").alias("value")).where("value <> 0")
