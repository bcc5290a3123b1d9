"""Line-first quality rules, in DataFrame functions only.

Each line is judged by rules of punctuation (symbols a word, a long line without a mark),
navigation, shouting and boilerplate (in English, German, French and Spanish); failing lines and
lines that repeat an earlier one are removed; a document that loses too much of its text this way,
or that fails the counts over its words, is rejected.

Steps that later ones read again leave through a generator, so that each is computed once. Windows of
three words are told apart by a 64-bit hash of their words' hashes; only texts with two equal ones
are searched for their places.

Edge cases: a null text is an empty text (no words, rejected); blank lines are neither judged nor
kept; repeated rows are judged alike; an empty table gives an empty table; columns of the input
named like a result column are not read, others pass through whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from groundwork.llm.text import WORD, whole, words


@dataclass(frozen=True)
class Rules:
    """Bounds of the rules.

    max_marks: symbols and exclamation marks a word of a line may have on average.
    max_bars: navigation separators a word of a line may have on average, from three on.
    open_words: words from which on one of several lines must have a mark that parts or ends sentences.
    min_left: share of the characters that must be left after removal of failing lines.
    boilerplate: phrases, in lower case, that mark a line of at most boilerplate_words words.
    """

    max_marks: float = 0.4
    max_bars: float = 0.2
    open_words: int = 12
    min_left: float = 0.5
    min_words: int = 50
    max_repeat_percent: int = 50
    boilerplate_words: int = 20
    boilerplate: tuple[str, ...] = (
        "all rights reserved", "click here", "cookie policy", "enable javascript", "lorem ipsum",
        "privacy policy", "read more", "share this", "sign up", "skip to content", "subscribe to",
        "terms of service", "terms of use", "use cookies",
        "alle rechte vorbehalten", "hier klicken", "weiterlesen", "datenschutzerklärung", "javascript aktivieren", "verwendet cookies", "zum inhalt springen", "newsletter abonnieren", "nutzungsbedingungen",
        "tous droits réservés", "cliquez ici", "lire la suite", "politique de confidentialité", "activer javascript", "utilise des cookies", "aller au contenu", "conditions d'utilisation",
        "todos los derechos reservados", "haga clic aquí", "leer más", "política de privacidad", "habilitar javascript", "utiliza cookies", "saltar al contenido", "términos de uso",
    )


MARKS, BARS, SYMBOLS, BLANKS = r"[!?#*$%&|<>{}\[\]~^=_\\@]", "[|»›•·]", "[#*$%&|<>]", "[\\x20\\x09-\\x0D]"
#: Marks that part or end sentences.
STOPS = "[.,!?…:;。，！？；：]"


def _count(text: Column, chars: str) -> Column:
    return F.regexp_count(text, F.lit(chars))


def line_passes(line: Column, low: Column, several: Column, r: Rules) -> Column:
    """Whether a line with a word, in lower case ``low``, passes all the line rules; a text of one line
    (``several`` is false) may lack marks."""
    n = _count(line, r"[ \t]") + 1
    bars = _count(line, BARS)
    loud = ~line.rlike(r"\p{Ll}") & line.rlike(r"\p{Lu}") & (n >= 4)
    open_ = ~line.rlike(STOPS) & several & (n >= r.open_words)
    said = F.lit(False)
    for phrase in r.boilerplate:
        said = said | low.contains(phrase)
    stock = (n <= r.boilerplate_words) & said
    return ~((_count(line, MARKS) > r.max_marks * n) | ((bars >= 3) & (bars > r.max_bars * n)) | loud | open_ | stock)


def _made(**cols: Column) -> Column:
    """The columns, computed once: they leave through a generator."""
    return F.inline(F.array(F.struct(*[c.alias(n) for n, c in cols.items()])))


def _lines(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD))


def _windows(hashes: str) -> Column:
    """A hash of each three words in a row, from the hashes of the words."""
    h, n = F.col(hashes), F.size(hashes)
    starts = F.when(n >= 3, F.sequence(F.lit(0), n - 3)).otherwise(F.expr("array()").cast("array<int>"))
    return F.transform(starts, lambda i: F.xxhash64(F.get(h, i), F.get(h, i + 1), F.get(h, i + 2)))


def _placed(windows: str) -> Column:
    """(h, p) of the windows and their places, by h; empty where all windows differ."""
    g = F.col(windows)
    pairs = F.sort_array(F.transform(g, lambda h, i: F.struct(h.alias("h"), i.alias("p"))))
    return F.when(F.size(F.array_distinct(g)) < F.size(g), pairs).otherwise(F.expr("array()").cast("array<struct<h:bigint,p:int>>"))


def _twice(placed: str) -> Column:
    """The places of windows that stand there twice or more."""
    s = F.col(placed)
    same = lambda e, j: F.coalesce(F.get(s, j)["h"] == e["h"], F.lit(False))
    return F.transform(F.filter(s, lambda e, j: same(e, j - 1) | same(e, j + 1)), lambda e: e["p"])


def _covered(places: str) -> Column:
    """How many words the windows of three at ``places`` cover."""
    p = F.col(places)
    return F.size(F.array_union(F.array_union(p, F.transform(p, lambda x: x + 1)), F.transform(p, lambda x: x + 2)))


def judge(docs: DataFrame, rules: Rules | None = None, text: str = "text") -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept
    and cleaned (the text without its failing and repeated lines). One scan, no shuffle."""
    r = rules or Rules()
    passed = [c for c in docs.columns if c in ("doc_id", text) or c not in RESULT]
    rows = docs.select(F.struct(*[docs[c] for c in passed]).alias("row"), whole(text).alias("t"))
    rows = rows.select("row", "t", _made(w=words(F.col("t"))))
    rows = rows.select("row", "t", _made(h=F.transform("w", lambda w: F.xxhash64(w))))
    rows = rows.select("row", "t", F.size("h").cast("long").alias("n_words"), _made(g=_windows("h")))
    rows = rows.select("row", "t", "n_words", _made(s=_placed("g")))
    rows = rows.select("row", "t", "n_words", _made(p=_twice("s"), lines=_lines(F.col("t")), lows=_lines(F.lower("t"))))
    left = F.array_distinct(F.filter("lines", lambda x, i: line_passes(x, F.get("lows", i), F.size("lines") > 1, r)))
    rows = rows.select("row", "t", "n_words", _made(n_repeat_words=_covered("p").cast("long"), lines=F.col("lines"), left=left))
    size = lambda c: F.length(F.array_join(c, ""))
    failed = (F.col("n_words") < r.min_words) | (F.col("n_repeat_words") * 100 > F.col("n_words") * r.max_repeat_percent)
    result = {
        "n_words": F.col("n_words"), "word_chars": (F.length("t") - _count(F.col("t"), BLANKS)).cast("long"), "n_symbols": _count(F.col("t"), SYMBOLS).cast("long"),
        "n_dup_lines": (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"), "n_repeat_words": F.col("n_repeat_words"), "base_failed": failed,
        "kept": ~failed & (size("left") >= r.min_left * size("lines")), "cleaned": F.array_join("left", "\n"),
    }
    return rows.select("row", _made(**result)).select(*[F.col("row")[c].alias(c) for c in passed], *RESULT)


RESULT = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "cleaned")


def keep_clean(docs: DataFrame, rules: Rules | None = None) -> DataFrame:
    """The documents that pass, with their cleaned text, in the columns of ``docs``, which may be
    named like results. n_chars, where there is one, follows the text."""
    packed = docs.select("text", F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    new = {"text": F.col("cleaned"), "n_chars": F.length("cleaned").cast("long")}
    return judge(packed, rules).filter("kept").select(*[new.get(c, F.col("row")[c]).alias(c) for c in docs.columns])
