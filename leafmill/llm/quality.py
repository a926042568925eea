"""Line-first quality cleaning, with DataFrame expressions only.

Every line is judged by itself (symbols, navigation, missing punctuation,
boilerplate phrases); failing lines are removed, and a document that loses
too much of its text is rejected.  A null text counts as an empty one, which
is rejected; rows keep their multiplicity and order of columns; additional
columns pass through ``clean`` untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, WORD, fresh, let, text_of

#: Phrases that mark a line as boilerplate (lower case, Java regex).
BOILERPLATE = (
    r"all rights reserved|©|copyright \(c\)|terms of (use|service)|privacy policy|cookie policy|accept (all )?cookies|"
    r"enable javascript|javascript is (disabled|required)|lorem ipsum|click here|read more$|sign up (now|for)|subscribe (now|to our)|"
    r"powered by|^licensed under|^released under the|is licensed under the|^share (this|on)|"
    r"alle rechte vorbehalten|datenschutzerklärung|^impressum$|cookies akzeptieren|tous droits réservés|politique de confidentialité|accepter (tous )?les cookies|"
    r"todos los derechos reservados|política de privacidad|aceptar (todas las )?cookies"
)
#: Tokens that separate the links of a navigation bar.
SEPARATOR = r"^[|>/»›•·]+$"
SYMBOLS = r"[^#*$%&|<>{}\\^~=_]+"
#: Marks that end or structure a sentence, in several scripts.
SENTENCE = r"[.!?;:,…。！？؟।]"

MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW = 20, 30, 8
MAX_SYMBOL_PERCENT, MIN_NAV, NAV_PERCENT, LONG_LINE, MIN_KEPT_PERCENT = 10, 3, 25, 12, 50


def squeezed(x: Column) -> Column:
    """Length without ASCII white space."""
    return F.length(F.regexp_replace(x, SPACE, ""))


#: One of these is in every line that BOILERPLATE finds.
HINTS = (
    "all rights reserved", "©", "copyright (c)", "terms of", "privacy policy", "cookie", "javascript", "lorem ipsum", "click here", "read more", "sign up", "subscribe", "powered by",
    "licensed under", "released under", "share ", "rechte vorbehalten", "datenschutzerkl", "impressum", "droits réservés", "confidentialité", "derechos reservados", "privacidad",
)


def hinted(text: Column) -> Column:
    """Whether a text can have a boilerplate phrase at all: plain searches, so that most texts skip the pattern."""
    def any_of(low: Column) -> Column:
        out = F.contains(low, F.lit(HINTS[0]))
        for h in HINTS[1:]:
            out |= F.contains(low, F.lit(h))
        return out

    return let(F.lower(text), any_of)


def line_fails(line: Column, hint: Column) -> Column:
    """True for a line that one of the line rules removes; blank lines never fail.  hint: see ``hinted``, of the line or its text.

    Cheap tests come first; And and Or stop at the first that decides.
    """
    words = F.split(F.regexp_replace(line, f"^{SPACE}|{SPACE}$", ""), SPACE)
    separators = F.size(F.filter(words, lambda w: w.rlike(SEPARATOR)))
    symbols = F.length(F.regexp_replace(line, SYMBOLS, ""))
    return line.rlike(WORD) & (
        ((symbols > 0) & (symbols * 100 > squeezed(line) * MAX_SYMBOL_PERCENT))
        | (line.rlike(r"[|>/»›•·]") & (separators >= MIN_NAV) & (separators * 100 >= F.size(words) * NAV_PERCENT))
        | (~line.rlike(SENTENCE) & (F.size(words) >= LONG_LINE))
        | (hint & F.lower(line).rlike(BOILERPLATE))
    )


def cleaned(text: Column) -> Column:
    """The text without its failing lines."""
    return let(hinted(text), lambda hint: F.array_join(F.filter(F.split(text, "\n"), lambda x: ~line_fails(x, hint)), "\n"))


def repeat_words(words: Column, window: int = WINDOW) -> Column:
    """How many words lie in a window of `window` words that occurs at least twice.

    Windows are compared by 64-bit hashes of their words' hashes, within one text only.
    Starts of repeated windows, in order, cover min(window, distance to the next start) words each.
    """

    def cover(marked: Column) -> Column:
        starts = F.array_sort(
            F.transform(
                F.filter(marked, lambda x, i: (F.get(marked, i - 1)["h"] == x["h"]) | (F.get(marked, i + 1)["h"] == x["h"])),
                lambda x: x["i"],
            )
        )
        return let(starts, lambda s: F.aggregate(
            F.transform(s, lambda p, i: F.least(F.lit(window), F.coalesce(F.get(s, i + 1), p + window) - p)),
            F.lit(0).cast("long"), lambda a, x: a + x,
        ))

    def some(hashes: Column) -> Column:
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("long")).otherwise(
            let(F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))), cover)
        )

    def joined(h: Column, size: int) -> Column:
        """Hashes of the runs of `size` elements from each place on, by halves; the last size - 1 are cut short."""
        if size == 1:
            return h
        half = size // 2
        runs = let(joined(h, half), lambda r: F.transform(r, lambda x, i: F.xxhash64(x, F.get(r, i + half))))
        return runs if size % 2 == 0 else let(runs, lambda r: F.transform(r, lambda x, i: F.xxhash64(x, F.get(h, i + (size - 1)))))

    def windows(h: Column) -> Column:
        return F.slice(joined(h, window), 1, F.size(h) - (window - 1))

    return F.when(F.size(words) < window + 1, F.lit(0).cast("long")).otherwise(
        let(F.transform(words, lambda w: F.xxhash64(w)), lambda h: let(windows(h), some))
    )


def measure(docs: DataFrame) -> DataFrame:
    """doc_id with the base counts, base_failed, the cleaned text and the verdict."""
    text = text_of(docs)
    step = docs.select(
        docs["doc_id"],
        text.alias("_t"),
        F.filter(F.split(text, SPACE), lambda w: w != "").alias("_w"),
        F.split(text, "\n").alias("_l"),
    )
    worded = F.filter(F.col("_l"), lambda x: x.rlike(WORD))
    step = step.select(
        "doc_id", "_t",
        F.size("_w").cast("long").alias("n_words"),
        squeezed(F.col("_t")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("_t", r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        let(worded, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        repeat_words(F.col("_w")).alias("n_repeat_words"),
        cleaned(F.col("_t")).alias("clean_text"),
    )
    failed = (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PERCENT)
    enough = squeezed(F.col("clean_text")) * 100 >= F.col("word_chars") * MIN_KEPT_PERCENT
    return step.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), (~failed & enough).alias("kept"), "clean_text",
    )


def clean(docs: DataFrame) -> DataFrame:
    """The documents that pass, their failing lines removed; same columns as the input."""
    text = text_of(docs)
    words = F.filter(F.split(text, SPACE), lambda w: w != "")
    (new,) = fresh(docs.columns, "_clean")
    # an array of the cleaned text, or of nothing: a filter above a column would be pushed below it, and clean every text twice
    fit = F.filter(F.array(words), lambda w: (F.size(w) >= MIN_WORDS) & (repeat_words(w) * 100 <= F.size(w) * MAX_REPEAT_PERCENT))
    left = F.filter(F.transform(fit, lambda w: cleaned(text)), lambda x: squeezed(x) * 100 >= squeezed(text) * MIN_KEPT_PERCENT)
    step = docs.select("*", F.explode(left).alias(new))
    rewritten = {"text": F.col(new)} | ({"n_chars": F.length(new).cast("long")} if "n_chars" in docs.columns else {})
    return step.select(*[rewritten.get(c, F.col(f"`{c}`")).alias(c) for c in docs.columns])
