"""Column expressions over texts. Character classes follow Unicode as Python's str methods do."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# White space and line boundaries of Unicode strings.
SPACE = r"\t\n\x0B\f\r\x1C-\x1F \x85\xA0" + "\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: SPACE as its characters, and what one blank stands for in SPACE-separated texts: any run but a single blank.
SPACES = "\t\n\x0b\f\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
GAP = rf" [{SPACE}]+|[{SPACE.replace(' ', '')}][{SPACE}]*"
LINE_BREAK = r"\r\n|[\n\r\x0B\f\x1C-\x1E\x85" + "\u2028\u2029]"
WORD = r"[\p{L}\p{N}_]+"
NO_WORD = r"[^\p{L}\p{N}_]+"
CHARS_PER_TOKEN = 3.6
NEAR_EMPTY_TOKENS = 20
LARGE_BYTES = 10 * 1024 * 1024

# What counts as markup, boilerplate, a control character and closing punctuation.
TAG = rf"</?[A-Za-z][A-Za-z0-9:-]*(?:[{SPACE}][^<>]*)?/?>"
ENTITY = r"&(?:[a-z]{2,8}|#\p{Nd}{2,5}|#x[0-9a-fA-F]{2,4});"
CONTROL = r"[\x00-\x08\x0E-\x1F\x7F-\x9F" + "\ufffd]"
TERMINAL = ".!?…:;\"')]}»"
BOILERPLATE = (
    rf"(?iu)(?:©|\(c\)[{SPACE}]*\p{{Nd}}{{4}}|copyright|all rights reserved|unsubscribe|cookie|privacy policy|terms of (?:use|service)"
    r"|page \p{Nd}+ of \p{Nd}+|confidential(?:ity)? notice|do not (?:forward|distribute))"
)

#: In lower case, what every match of BOILERPLATE has some of; and the characters beyond ASCII that match one of its letters.
BOILERPLATE_HINTS = ("©", "(c)", "copyright", "all rights", "unsubscribe", "cookie", "privacy", "terms of", "page ", "confidential", "do not")
FOLDED = "\u017f\u0130\u0131\u212a"

# UTF-8 read as Windows-1252. Own rule, approximate: a lead byte's character and the images of its
# continuation bytes; three and four byte forms need an image outside U+00A0-U+00BF, so that
# accented letters before a guillemet don't count.
_HIGH = "€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ\\x81\\x8D\\x8F\\x90\\x9D"
_TAIL = _HIGH + "\\xA0-\\xBF"
MOJIBAKE = rf"[ÂÃ][{_TAIL}]|[à-ï](?:[{_HIGH}][{_TAIL}]|[{_TAIL}][{_HIGH}])|[ð-ô][{_HIGH}][{_TAIL}]{{2}}"


def decode(content: Column) -> Column:
    """Bytes as UTF-8, malformed sequences replaced."""
    return F.make_valid_utf8(content.cast("string"))


def strip(text: Column) -> Column:
    return F.regexp_replace(text, rf"^[{SPACE}]+|[{SPACE}]+$", "")


def lines(text: Column) -> Column:
    """Stripped lines that aren't blank."""
    return F.filter(F.transform(F.split(text, LINE_BREAK), strip), lambda x: x != "")


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def word_text(text: Column) -> Column:
    """The words in lower case, a blank between them: one string moves to Python faster than an array. No letter's case depends on what is beyond a blank."""
    return F.lower(F.regexp_replace(text, NO_WORD, " "))


def token_estimate(text: Column) -> Column:
    """Characters over CHARS_PER_TOKEN, halves to even, at least 1 for a text that has any."""
    n = F.length(text)
    return F.when(n == 0, 0).otherwise(F.greatest(F.lit(1.0), F.rint(n / F.lit(CHARS_PER_TOKEN)))).cast("long")


def round6(x: Column) -> Column:
    return F.bround(x, 6)


def is_empty(text: Column) -> Column:
    return ~text.rlike(rf"[^{SPACE}]")


def is_near_empty(text: Column) -> Column:
    return token_estimate(text) < NEAR_EMPTY_TOKENS


def is_truncated(text: Column, banner: str) -> Column:
    """Not near-empty, and what is left without closing banner lines and markup doesn't end in punctuation.

    Closing lines are banners only in texts that have their words, and markup only where its last characters are; all
    other texts, nearly every one, are judged by their last character alone.
    """
    own = F.split(strip(text), LINE_BREAK)
    kept = F.filter(own, lambda x: x.rlike(rf"[^{SPACE}]"))
    body = F.aggregate(
        F.reverse(kept),
        F.struct(F.lit(False).alias("on"), F.array().cast("array<string>").alias("rows")),
        lambda acc, x: F.when(acc["on"] | ~x.rlike(banner), F.struct(F.lit(True).alias("on"), F.concat(acc["rows"], F.array(x)).alias("rows"))).otherwise(acc),
        lambda acc: F.array_join(F.reverse(acc["rows"]), "\n"),
    )
    marked = F.contains(text, F.lit("SECRET")) | F.contains(text, F.lit("CONFIDENTIAL")) | F.contains(text, F.lit("CUI")) | F.contains(text, F.lit("CLASSIFIED"))
    body = F.when(marked, body).otherwise(text)
    clean = F.when(F.contains(text, F.lit(">")) | F.contains(text, F.lit(";")), F.regexp_replace(F.regexp_replace(body, TAG, ""), ENTITY, "")).otherwise(body)
    # Nothing is contained in every text, so an empty rest counts as closed.
    return ~is_near_empty(text) & ~F.contains(F.lit(TERMINAL), F.right(F.rtrim(clean, F.lit(SPACES)), F.lit(1)))


def is_mojibake(text: Column) -> Column:
    return text.rlike(MOJIBAKE)


def has_control_chars(text: Column) -> Column:
    return text.rlike(CONTROL)


def has_markup(text: Column) -> Column:
    return text.rlike(TAG) | text.rlike(ENTITY)


def boilerplate_share(text: Column) -> Column:
    """Share of lines with fewer than four words or a boilerplate phrase; 0 below two lines.

    Lines are made once and only their first four words are looked for; phrases are sought only in texts that may have one.
    """
    four = rf"(?:{WORD}+{NO_WORD}+){{3}}[\p{{L}}\p{{N}}_]"

    def shares(phrases: bool) -> Column:
        short = lambda x: ~x.rlike(four) | x.rlike(BOILERPLATE) if phrases else ~x.rlike(four)
        add = lambda n, is_so: n + F.when(is_so, 1).otherwise(0)
        return F.aggregate(
            F.filter(F.split(text, LINE_BREAK), lambda x: x.rlike(rf"[^{SPACE}]")),
            F.struct(F.lit(0).alias("n"), F.lit(0).alias("short")),
            lambda acc, x: F.struct((acc["n"] + 1).alias("n"), add(acc["short"], short(x)).alias("short")),
            lambda acc: F.when(acc["n"] < 2, 0.0).otherwise(round6(acc["short"] / acc["n"])),
        )

    hint = F.lit(False)
    for x in FOLDED:
        hint = hint | F.contains(text, F.lit(x))
    for x in BOILERPLATE_HINTS:
        hint = hint | F.contains(F.lower(text), F.lit(x))
    return F.when(hint, shares(True)).otherwise(shares(False))


def intra_doc_repetition(text: Column) -> Column:
    """Share of lines that repeat an earlier one, case and spacing aside; 0 below two lines."""
    own = F.transform(F.split(F.lower(text), LINE_BREAK), lambda x: F.regexp_replace(F.btrim(x, F.lit(SPACES)), GAP, " "))
    share = lambda a: F.when(F.size(a) < 2, 0.0).otherwise(round6((F.size(a) - F.size(F.array_distinct(a))) / F.size(a)))
    # As a lambda's variable the lines are made once; as an expression, each time they are named.
    return F.get(F.transform(F.array(F.filter(own, lambda x: x != "")), share), F.lit(0))


def _repeated_share(words: list[str]) -> float:
    known: dict[str, int] = {}
    n = len(words)
    codes = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, n)
    lengths = np.fromiter(map(len, words), np.int64, n)
    total, worst, grams = int(lengths.sum()), 0.0, codes
    for size in (2, 3, 4):
        if n < size:
            break
        # Grams are numbered anew for each size, so a number stays below n * n.
        _, grams, often = np.unique(grams[: n - size + 1] * len(known) + codes[size - 1 :], return_inverse=True, return_counts=True)
        again = np.flatnonzero(often[grams] > 1)
        if not len(again):
            break  # a longer gram has this one in it
        edge = np.bincount(again, minlength=n + 1) - np.bincount(again + size, minlength=n + 1)[: n + 1]
        worst = max(worst, int(lengths[np.cumsum(edge)[:n] > 0].sum()) / total)
    return round(worst, 6)


def _repeated_shares(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: _repeated_share(own.split(" ")) if isinstance(t, str) and (own := t.strip(" ")) else 0.0)


def ngram_repetition(text: Column) -> Column:
    """Share of word characters inside a 2-, 3- or 4-gram that occurs more than once, the largest of the three.

    The grams of one document matter to no other: a vectorised function per batch needs no shuffle,
    where exploding the words would shuffle the corpus three times.
    """
    return F.pandas_udf(_repeated_shares, "double")(word_text(text))
