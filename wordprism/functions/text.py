"""Text predicates and cleaning as column expressions (all stay in the JVM)."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Character classes shared by every tokenising expression.
WORD = r"[\p{L}\p{N}_]"
NOT_WORD_OR_SPACE = r"[^\p{L}\p{N}_\s]"
BLANKS = " \t\n\x0b\f\r"

# Patterns that decide which tokens are left out.
# The "." before the decimals matches any character on purpose ("3d5" is a number).
NUMBER = (
    r"^(?:-(?:[1-9](?:\d{0,2}(?:,\d{3})+|\d*))|(?:0|(?:[1-9](?:\d{0,2}(?:,\d{3})+|\d*))))(?:.\d+|)$"
)
ORDINAL = r"^\d+(?:st|nd|rd|th)"
DECADE = r"^(\d{2}|\d{4})s"
LETTER = "[a-zA-Z]"
EMAIL = r"([\p{L}\p{N}_.\-]+@[\p{L}\p{N}_.\-]+)"

# Marks that models add around and inside a sequence.
SPECIAL_TOKENS = ("[UNK]", "[SEP]", "[PAD]", "[CLS]", "[MASK]", "<s>", "</s>", "<unk>", "<pad>", "<mask>")
CONTINUATION_MARK = "##"

# Accented letters and their plain form, one to one.
ACCENTED = "àáâãäåāăąçćčďèéêëēėęěìíîïīįłñńňòóôõöøōřśšťùúûüūůýÿźżž"
PLAIN = "aaaaaaaaacccdeeeeeeeeiiiiiilnnnooooooorsstuuuuuuyyzzz"


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def strip(value: Column | str) -> Column:
    """Without white space at both ends."""
    return F.trim(_col(value), F.lit(BLANKS))


def squash_newlines(value: Column | str) -> Column:
    """Runs of line breaks become one blank; ends are stripped."""
    return strip(F.regexp_replace(_col(value), r"\n+", " "))


def format_quotes(value: Column | str) -> Column:
    """Two apostrophes become one quotation mark."""
    return F.replace(_col(value), F.lit("''"), F.lit('"'))


def title_and_text(title: Column | str, text: Column | str) -> Column:
    """Stripped title, a blank, stripped text; null when either is null."""
    return F.concat(strip(title), F.lit(" "), strip(text))


def prefixed_id(prefix: str, *parts: Column | str) -> Column:
    """``prefix`` followed by the id columns."""
    return F.concat(F.lit(prefix), *[_col(p).cast("string") for p in parts])


def label_from_flags(flags: Sequence[Column | str], names: Sequence[str]) -> Column:
    """Name of the first highest flag (all zero gives the first name)."""
    values = F.array(*[_col(f) for f in flags])
    labels = F.array(*[F.lit(n) for n in names])
    return F.element_at(labels, F.array_position(values, F.array_max(values)).cast("int"))


def label_from_rating(score: Column | str, threshold: float = 3) -> Column:
    """``bad`` below the threshold, ``good`` from it on, null for no rating."""
    score = _col(score)
    return F.when(score < threshold, "bad").when(score >= threshold, "good")


def effective_label(label: Column | str = "label", topic: Column | str = "topic") -> Column:
    return F.coalesce(_col(label), _col(topic))


def length_within(text: Column | str, longest: int | None = 5000) -> Column:
    """Not empty and at most ``longest`` characters."""
    size = F.length(_col(text))
    return size > 0 if longest is None else size.between(1, longest)


def _whole_word(key: str) -> str:
    """Pattern of ``key`` between word boundaries that know all letters."""
    def is_word(ch: str) -> bool:
        return ch.isalnum() or ch == "_"

    left = f"(?<!{WORD})" if is_word(key[0]) else f"(?<={WORD})"
    right = f"(?!{WORD})" if is_word(key[-1]) else f"(?={WORD})"
    return left + re.escape(key) + right


def map_text(text: Column | str, pairs: Mapping[str, str] | Iterable[tuple[str, str]]) -> Column:
    """Replace whole words, one key after the other, in the given order.

    A later key sees what earlier ones wrote; replacements are literal text.
    """
    result = _col(text)
    for key, value in dict(pairs).items():
        literal = value.replace("\\", "\\\\").replace("$", "\\$")
        result = F.regexp_replace(result, _whole_word(key), literal)
    return result


def whole_word(key: Column | str) -> Column:
    """The pattern of :func:`map_text` for keys that come as a column."""
    key = _col(key)
    quoted = F.concat(F.lit("\\Q"), F.replace(key, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))
    left = F.when(key.rlike(f"^{WORD}"), f"(?<!{WORD})").otherwise(f"(?<={WORD})")
    right = F.when(key.rlike(f"{WORD}$"), f"(?!{WORD})").otherwise(f"(?={WORD})")
    return F.concat(left, quoted, right)


def literal(value: Column | str) -> Column:
    """A replacement that stands for itself."""
    slashes = F.replace(_col(value), F.lit("\\"), F.lit("\\\\"))
    return F.replace(slashes, F.lit("$"), F.lit("\\$"))


def map_text_by(text: Column | str, pairs: Column) -> Column:
    """:func:`map_text` for an array of ``pattern, literal``: the plan does not grow with the map."""
    return F.aggregate(pairs, _col(text), lambda done, pair: F.regexp_replace(done, pair["pattern"], pair["literal"]))


def is_number(token: Column | str) -> Column:
    token = _col(token)
    return token.rlike(r"^\p{N}+$") | token.rlike(NUMBER)


def is_ordinal(token: Column | str) -> Column:
    return F.lower(_col(token)).rlike(ORDINAL)


def is_decade(token: Column | str) -> Column:
    return F.lower(_col(token)).rlike(DECADE)


def has_letter(token: Column | str) -> Column:
    return _col(token).rlike(LETTER)


def without_punctuation(token: Column | str) -> Column:
    return F.regexp_replace(_col(token), NOT_WORD_OR_SPACE, "")


def stop_key(token: Column | str) -> Column:
    """The form in which a token is looked up among the stop words."""
    return F.lower(without_punctuation(strip(token)))


def is_content(token: Column | str) -> Column:
    """All token tests but the stop-word one; most tokens need only two of them."""
    token = strip(token)
    numeric = token.rlike(r"\p{N}") & (is_ordinal(token) | is_decade(token) | is_number(token))
    return has_letter(token) & ~numeric


def normalize_text(text: Column | str) -> Column:
    """Lower case without accents; keeps the length, so spans stay valid."""
    return F.translate(F.lower(F.translate(_col(text), "İ", "I")), ACCENTED, PLAIN)


def clean_token(token: Column | str, mark: str = CONTINUATION_MARK) -> Column:
    return F.replace(_col(token), F.lit(mark), F.lit(""))


def is_special(token: Column | str, special: Iterable[str] = SPECIAL_TOKENS) -> Column:
    return _col(token).isin(*special)


def word_part(token: Column | str, word: Column | str) -> Column:
    """Where a token lies in its word: struct(before, part, after).

    A token that is not in the word leaves the word whole in ``after``.
    """
    token, word = strip(token), _col(word)
    at = F.instr(F.lower(word), F.lower(token))
    size = F.length(token)
    found = at > 0
    return F.struct(
        F.when(found, F.substring(word, F.lit(1), at - 1)).otherwise("").alias("before"),
        F.when(found, F.substring(word, at, size)).otherwise("").alias("part"),
        F.when(found, F.substring(word, at + size, F.length(word))).otherwise(word).alias("after"),
    )


def highlight(text: Column | str, pieces: Column | str, opening: str = "<mark>", closing: str = "</mark>") -> Column:
    """Wrap spans in marks.

    ``pieces`` lists disjoint spans in order as struct(start, end, previous), with
    the end of the span before. The text is cut at the borders and joined once.
    """
    text, pieces = _col(text), _col(pieces)
    marked = F.transform(
        pieces,
        lambda s: F.concat(
            F.substring(text, s["previous"] + 1, s["start"] - s["previous"]),
            F.lit(opening),
            F.substring(text, s["start"] + 1, s["end"] - s["start"]),
            F.lit(closing),
        ),
    )
    tail = F.substring(text, F.element_at(pieces, -1)["end"] + 1, F.length(text))
    return F.when(F.size(pieces) > 0, F.concat(F.array_join(marked, ""), tail)).otherwise(text)
