"""Word annotation from lookup tables, and its alignment with model tokens.

Tags, entity names and lemmas come from tables the caller supplies; small
defaults are built in. The joins are plain equi-joins: Spark broadcasts a lookup
table when its size allows and shuffles otherwise.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wordprism.operators.tokens import HYPHENATED, TOKEN, token_spans, tokens, without_stop_words

# Closed-class English words and their tags.
LEXICON = {
    "DT": "the a an this that these those",
    "IN": "of in on at by for with from into about after before under over between through during",
    "CC": "and or but nor yet",
    "PRP": "i you he she it we they me him her us them",
    "PRP$": "my your his its our their",
    "MD": "can could will would shall should may might must",
    "TO": "to",
    "VBZ": "is has does",
    "VBP": "are am have do",
    "VBD": "was were had did",
    "VB": "be",
    "WP": "who what whom",
    "WRB": "when where why how",
    "EX": "there",
    "RB": "not very too also then",
}

# Names of the tags.
TAG_NAMES = {
    "CC": "conjunction, coordinating",
    "CD": "numeral, cardinal",
    "DT": "determiner",
    "EX": "existential there",
    "IN": "preposition or conjunction, subordinating",
    "JJ": "adjective or numeral, ordinal",
    "MD": "modal auxiliary",
    "NN": "noun, common, singular or mass",
    "NNP": "noun, proper, singular",
    "NNS": "noun, common, plural",
    "PRP": "pronoun, personal",
    "PRP$": "pronoun, possessive",
    "RB": "adverb",
    "TO": "\"to\" as preposition or infinitive marker",
    "VB": "verb, base form",
    "VBD": "verb, past tense",
    "VBG": "verb, present participle or gerund",
    "VBP": "verb, present tense, not 3rd person singular",
    "VBZ": "verb, present tense, 3rd person singular",
    "WP": "WH-pronoun",
    "WRB": "Wh-adverb",
    ".": "sentence terminator",
    ",": "comma",
    ":": "colon or ellipsis",
}

# Tag by form, first match decides.
TAG_RULES = (
    ("CD", r"^\p{N}+$"),
    (".", r"^[.!?]$"),
    (",", r"^,$"),
    (":", r"^[:;\-]$"),
    ("SYM", r"^[^\p{L}\p{N}_]$"),
    ("NNP", r"^\p{Lu}"),
    ("VBG", r"ing$"),
    ("VBD", r"ed$"),
    ("RB", r"ly$"),
    ("JJ", r"(able|ible|ful|ous|ive|al)$"),
    ("NNS", r"[^s]s$"),
)
OTHER_TAG, PROPER = "NN", "NNP"

# Endings and what stands in their place, first match decides.
STEM_RULES = (
    (r"sses$", "ss"), (r"ies$", "i"), (r"(.{3,})ing$", "$1"), (r"(.{3,})ed$", "$1"),
    (r"(.{3,})ly$", "$1"), (r"([^s])s$", "$1"),
)


def _table(spark: SparkSession, rows: list[tuple[str, str]], key: str, value: str) -> DataFrame:
    """A small lookup table as literals, so that its size is known to the planner."""
    entries = F.array(*[F.struct(F.lit(k).alias(key), F.lit(v).alias(value)) for k, v in rows])
    return spark.range(1).select(F.inline(entries))


def lexicon(spark: SparkSession) -> DataFrame:
    return _table(spark, [(w, tag) for tag, words in LEXICON.items() for w in words.split()], "word", "tag")


def tag_names(spark: SparkSession) -> DataFrame:
    return _table(spark, list(TAG_NAMES.items()), "tag", "name")


def words(texts: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Words and marks of a text; hyphenated words stay whole."""
    return token_spans(texts, HYPHENATED, keep).withColumnRenamed("pos", "tag_idx").withColumnRenamed("token", "word")


_ENDINGS = re.compile(r"\(?([a-z|]+)\)?\$")


def _fits(word: Column, pattern: str) -> Column:
    """``word`` has the form ``pattern``; words hold no white space, so plain endings need no search."""
    plain = _ENDINGS.fullmatch(pattern)
    if not plain:
        return word.rlike(pattern)
    return reduce(lambda a, b: a | b, [F.endswith(word, F.lit(ending)) for ending in plain[1].split("|")])


def form_tag(word: Column) -> Column:
    """The tag of the first rule that fits a word. Words that begin with a to z need only the rules on endings."""

    def first(rules: list[tuple[str, str]]) -> Column:
        return reduce(lambda rest, rule: F.when(_fits(word, rule[1]), rule[0]).otherwise(rest), reversed(rules), F.lit(OTHER_TAG))

    # by bytes, so between "a" and the mark behind "z" lie the words that begin with one of these letters
    return F.when((word >= "a") & (word < "{"), first([r for r in TAG_RULES if not r[1].startswith("^")])).otherwise(first(list(TAG_RULES)))


def pos_tags(word_rows: DataFrame, lexicon: DataFrame, names: DataFrame) -> DataFrame:
    """Add ``tag`` and ``tag_desc``: lexicon first, then the form of the word."""
    by_form = form_tag(F.col("word"))
    known = lexicon.select(F.col("word").alias("_key"), F.col("tag").alias("_tag"))
    tagged = word_rows.join(known, F.lower("word") == F.col("_key"), "left").drop("_key")
    tagged = tagged.withColumn("tag", F.coalesce("_tag", by_form)).drop("_tag")
    described = tagged.join(names.select("tag", F.col("name").alias("_name")), "tag", "left")
    described = described.withColumn(
        "tag_desc", F.coalesce(F.concat("_name", F.lit(" ("), "tag", F.lit(")")), F.col("tag"))
    )
    return described.select(*word_rows.columns, "tag", "tag_desc")


def proper_nouns(word_rows: DataFrame, lexicon: DataFrame, names: DataFrame) -> DataFrame:
    """The proper nouns among what :func:`pos_tags` gives; only words that may be some are tagged: by their form or by the lexicon."""
    form = dict(TAG_RULES)[PROPER]
    listed = lexicon.where(F.col("tag") == PROPER).select(F.col("word").alias("_key"))
    listed = word_rows.where(~F.col("word").rlike(form)).join(listed, F.lower("word") == F.col("_key"), "left_semi")
    formed = pos_tags(word_rows.where(F.col("word").rlike(form)), lexicon, names)
    return formed.unionByName(pos_tags(listed, lexicon, names)).where(F.col("tag") == PROPER)


def named_entities(
    tagged: DataFrame, gazetteer: DataFrame | None = None, other: str = "NAME", nouns: DataFrame | None = None
) -> DataFrame:
    """Add ``entity``: runs of capitalised words, named by the gazetteer.

    Neighbouring proper nouns form one run. Its name is looked up (``name,
    entity``, lower case, words joined by blanks) and falls back to ``other``. Only
    proper nouns are moved, once, to the other words of their text. ``nouns`` are those of
    ``tagged`` where they are had for less (:func:`proper_nouns`).
    """
    proper = F.col("tag") == PROPER
    if gazetteer is None:
        return tagged.withColumn("entity", F.when(proper, other))
    order = Window.partitionBy("text_id").orderBy("tag_idx")
    runs = (tagged.where(proper) if nouns is None else nouns).withColumn("_before", F.lag("tag_idx").over(order))
    opens = F.col("_before").isNull() | (F.col("tag_idx") - F.col("_before") > 1)
    runs = runs.withColumn("_run", F.sum(opens.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    # a run lies in the task of its text already, so its words are gathered without moving them again
    listed = F.array_sort(F.collect_list(F.struct("tag_idx", F.lower("word").alias("w"))).over(Window.partitionBy("text_id", "_run")))
    name = F.when(F.col("text_id").isNotNull(), F.array_join(F.transform(listed, lambda x: x["w"]), " "))
    named = runs.withColumn("_name", name).join(gazetteer.select(F.col("name").alias("_name"), F.col("entity").alias("_entity")), "_name", "left")
    named = named.select(*tagged.columns, F.coalesce("_entity", F.lit(other)).alias("entity"))
    rest = tagged.where(~F.coalesce(proper, F.lit(False))).withColumn("entity", F.lit(None).cast("string"))
    return named.unionByName(rest)


def stemmed(word: Column | str) -> Column:
    word = F.col(word) if isinstance(word, str) else word
    result = word
    for pattern, form in reversed(STEM_RULES):
        result = F.when(word.rlike(pattern), F.regexp_replace(word, pattern, form)).otherwise(result)
    return result


def lemmatised(rows: DataFrame, lemmas: DataFrame, word: str = "word", name: str = "lemma") -> DataFrame:
    """Replace a word by its lemma (table ``word, lemma``) where one is known."""
    known = lemmas.select(F.col("word").alias("_key"), F.col("lemma").alias("_lemma"))
    joined = rows.join(known, F.col(word) == F.col("_key"), "left")
    return joined.withColumn(name, F.coalesce("_lemma", F.col(word))).drop("_key", "_lemma")


def align(token_rows: DataFrame, tags: DataFrame) -> DataFrame:
    """Give each token the first word with ``word.start <= token.end <= word.end``.

    Words of a text are disjoint and in order, so the first word that ends at or
    after the token's end is the only candidate. Tokens and words are laid in one
    stream per text and the last word seen from the right is carried along, which
    takes one sort instead of all token-word pairs. Tokens without a word get nulls.
    """
    payload = [c for c in ("word", "tag_desc", "entity") if c in tags.columns]
    item = F.struct(
        "tag_idx",
        *payload,
        F.col("start").cast("int").alias("tag_start"),
        F.col("end").cast("int").alias("tag_end"),
    )
    left = token_rows.select("text_id", F.struct(*[c for c in token_rows.columns if c != "text_id"]).alias("_t"), F.col("end").alias("_at"))
    right = tags.select("text_id", item.alias("_w"), F.col("end").alias("_at"))
    stream = left.unionByName(right, allowMissingColumns=True)
    # from the right; at the same end the word comes before the token
    order = Window.partitionBy("text_id").orderBy(F.desc("_at"), F.col("_w").isNull(), F.desc("_w.tag_idx"))
    carried = F.last("_w", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    seen = stream.withColumn("_w", carried).where(F.col("_t").isNotNull())
    matched = F.col("_w.tag_start") <= F.col("_t.end")
    return seen.select(
        "text_id",
        "_t.*",
        F.when(matched, F.col("_w.tag_idx")).alias("tag_idx"),
        *[F.when(matched, F.col(f"_w.{c}")).alias("tag_word" if c == "word" else c) for c in payload],
        F.when(matched, F.col("_w.tag_start")).alias("tag_start"),
        F.when(matched, F.col("_w.tag_end")).alias("tag_end"),
    )


_JOINT = r"(?<=\S)-(?=\S)"  # a hyphen inside a word


def _n_tokens(piece: Column) -> Column:
    """Model tokens of a word with the white space before it: a hyphen inside a word is a token, and so are its sides."""
    return F.lit(1) + F.when(F.contains(piece, F.lit("-")), 2 * F.regexp_count(piece, F.lit(_JOINT))).otherwise(F.lit(0))


def numbered_words(texts: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """:func:`words` with ``first``, the number of model tokens before each word."""
    rows = token_spans(texts, HYPHENATED, keep, counts={"first": _n_tokens})
    return rows.withColumnRenamed("pos", "tag_idx").withColumnRenamed("token", "word")


def counted_words(texts: DataFrame) -> DataFrame:
    """The distinct words of :func:`numbered_words` with their number ``n``; a word stands alone, so places are those within it."""
    rows = tokens(texts, HYPHENATED).groupBy(F.col("token").alias("word")).agg(F.count(F.lit(1)).alias("n"))
    nothing, zero = F.lit(None).cast("string"), F.lit(0)
    return rows.select(nothing.alias("text_id"), "n", zero.alias("tag_idx"), "word", zero.alias("start"), F.length("word").alias("end"), zero.alias("first"))


def word_tokens(tags: DataFrame) -> DataFrame:
    """The model tokens of annotated words, each with its word: what :func:`align` gives for the words of the text.

    ``tags`` comes from :func:`numbered_words`. Words are runs of whole tokens, so a
    word is cut into its tokens where it stands: no sort, no shuffle, no join.
    """
    payload = [c for c in ("word", "tag_desc", "entity") if c in tags.columns]
    keep = [c for c in tags.columns if c not in ("text_id", "tag_idx", "start", "end", "first", "tag", *payload)]
    single = F.array(F.struct(F.col("word").alias("token"), F.lit(0).alias("at")))
    pieces = F.regexp_extract_all("word", F.lit(TOKEN), F.lit(0))
    begin = lambda p, i: F.length(F.array_join(F.slice(pieces, F.lit(1), i), ""))
    several = F.transform(pieces, lambda p, i: F.struct(p.alias("token"), begin(p, i).alias("at")))
    cut = F.when(F.contains("word", F.lit("-")) & (F.length("word") > 1), several).otherwise(single)
    rows = tags.select("*", F.posexplode(cut).alias("_i", "_t"))
    start = F.col("start") + F.col("_t.at")
    return rows.select(
        "text_id", *keep, (F.col("first") + F.col("_i")).alias("pos"), F.col("_t.token").alias("token"),
        start.alias("start"), (start + F.length("_t.token")).alias("end"), "tag_idx",
        *[F.col(c).alias("tag_word" if c == "word" else c) for c in payload],
        F.col("start").cast("int").alias("tag_start"), F.col("end").cast("int").alias("tag_end"),
    )


def occurrences(tags: DataFrame, stop_words: DataFrame) -> DataFrame:
    """Long inverted index: one row per occurrence of a content token, with its annotated word."""
    return without_stop_words(word_tokens(tags), stop_words)
