"""Text tables: ``text_id, ord, text, processed_text, label, topic``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from wordprism.functions import text as tx
from wordprism.plans.ranking import with_global_rank
from wordprism.sources.tokenmap import replace_words

# The six flag columns and the names of their classes.
ABSTRACT_FLAGS = (
    "Computer Science", "Physics", "Mathematics", "Statistics", "Quantitative Biology", "Quantitative Finance",
)
ABSTRACT_LABELS = ("compsci", "physics", "math", "statistics", "biology", "finance")
STORY_END = "<|endoftext|>"
_LINES_PER_BLOCK = 100_000


def text_table(
    df: DataFrame,
    text_id: Column,
    ord: Column,
    text: Column,
    label: Column | None = None,
    topic: Column | None = None,
) -> DataFrame:
    """Bring any frame into the shape all operators expect."""
    nothing = F.lit(None).cast("string")
    return df.select(
        text_id.alias("text_id"),
        ord.cast("long").alias("ord"),
        text.alias("text"),
        nothing.alias("processed_text"),
        (nothing if label is None else label.cast("string")).alias("label"),
        (nothing if topic is None else topic.cast("string")).alias("topic"),
    )


def documents(spark: SparkSession, path: str, label: str = "lang", prefix: str = "doc_") -> DataFrame:
    """A parquet table (doc_id, text, label columns) as a Text table."""
    rows = spark.read.parquet(path)
    return text_table(rows, tx.prefixed_id(prefix, "doc_id"), F.col("doc_id"), F.col("text"), F.col(label))


def abstracts_csv(spark: SparkSession, path: str) -> DataFrame:
    """Titles and abstracts with six 0/1 class flags (columns 4 to 9)."""
    schema = T.StructType(
        [T.StructField("ID", T.LongType()), T.StructField("TITLE", T.StringType()), T.StructField("ABSTRACT", T.StringType())]
        + [T.StructField(name, T.IntegerType()) for name in ABSTRACT_FLAGS]
    )
    rows = spark.read.csv(path, schema=schema, header=True, multiLine=True, quote='"', escape='"', enforceSchema=True)
    flags = [F.col(f"`{name}`") for name in ABSTRACT_FLAGS]
    return text_table(
        rows,
        tx.prefixed_id("PaperAbstract_", "ID"),
        F.col("ID"),
        tx.title_and_text("TITLE", "ABSTRACT"),
        tx.label_from_flags(flags, ABSTRACT_LABELS),
    )


def reviews_csv(spark: SparkSession, path: str) -> DataFrame:
    """Reviews with a rating; unrated rows are left out, as no class fits them."""
    head = spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"')
    rows = head.select(F.expr("try_cast(Id as long)").alias("Id"), F.expr("try_cast(Score as int)").alias("Score"), "Text")
    rows = rows.where(F.col("Score").isNotNull())
    return text_table(
        rows,
        tx.prefixed_id("AmazonFoodReviews_", "Id"),
        F.col("Id"),
        tx.format_quotes("Text"),
        tx.label_from_rating("Score"),
    )


def folder_corpus(
    spark: SparkSession,
    root: str,
    longest: int | None = 5000,
    tokens: DataFrame | None = None,
    prefix: str = "BBCNews",
) -> DataFrame:
    """One text per file, the folder is the class; empty and over-long texts are dropped.

    ``tokens`` is a token map (ord, key, value).
    """
    files = spark.read.text(f"{root.rstrip('/')}/*/*.txt", wholetext=True)
    parts = F.split(F.col("_metadata.file_path"), "/")
    folder = F.url_decode(F.replace(F.element_at(parts, -2), F.lit("+"), F.lit("%2B")))
    stem = F.url_decode(F.replace(F.element_at(F.split(F.element_at(parts, -1), r"\."), 1), F.lit("+"), F.lit("%2B")))
    rows = files.select(folder.alias("label"), stem.alias("stem"), tx.squash_newlines("value").alias("text"))
    rows = rows.where(tx.length_within("text", longest))
    rows = rows.withColumn("text_id", F.concat_ws("_", F.lit(prefix), "label", "stem"))
    if tokens is not None:
        rows = replace_words(rows, "text", tokens)
    ranked = with_global_rank(rows.drop("stem"), ["text_id"], "ord")
    return text_table(ranked, F.col("text_id"), F.col("ord"), tx.format_quotes("text"), F.col("label"))


def delimited_stories(spark: SparkSession, path: str, end: str = STORY_END, prefix: str = "TinyStories_") -> DataFrame:
    """Stories of text files, one after the other by path, each closed by a line that holds only ``end``.

    Lines are stripped and joined without a separator; what follows the last
    end line is dropped. The id is the line number of the story's end line.
    """
    lines = spark.read.text(path).select(
        tx.strip("value").alias("line"),
        F.col("_metadata.file_path").alias("_path"),
        F.col("_metadata.file_block_start").alias("_split"),
        F.monotonically_increasing_id().alias("_at"),
    )
    numbered = with_global_rank(lines, ["_path", "_split", "_at"], "number").withColumn("number", F.col("number") + 1)
    # The end lines split the file into stories: a line belongs to the next end line.
    # Numbering the end lines is enough to know the story of each line, and it is
    # done per block of lines so that no task sees the whole file.
    block = (F.col("number") / F.lit(_LINES_PER_BLOCK)).cast("long")
    numbered = numbered.withColumn("block", block).withColumn("is_end", F.col("line") == end)
    ahead = Window.partitionBy("block").orderBy(F.desc("number")).rowsBetween(Window.unboundedPreceding, 0)
    local = F.last(F.when(F.col("is_end"), F.col("number")), ignorenulls=True).over(ahead)
    local_ends = numbered.withColumn("story", local)
    firsts = numbered.groupBy("block").agg(F.min(F.when(F.col("is_end"), F.col("number"))).alias("first_end"))
    later = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    following = firsts.select("block", F.last("first_end", ignorenulls=True).over(later).alias("next_end"))
    stories = (
        local_ends.join(following, "block")
        .withColumn("story", F.coalesce("story", "next_end"))
        .where(F.col("story").isNotNull())
        .groupBy("story")
        .agg(F.array_sort(F.collect_list(F.when(~F.col("is_end"), F.struct("number", "line")))).alias("lines"))
        .withColumn("text", F.array_join(F.transform("lines", lambda x: x["line"]), ""))
    )
    return text_table(stories, tx.prefixed_id(prefix, "story"), F.col("story"), F.col("text"))
