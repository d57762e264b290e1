"""Text expressions: Python-style strip, keyword extraction, truncation.

Keyword extraction (KW-1, KW-2) is pure Spark SQL: whole word tokens are
pulled out with one regex, then kept only if the whole token is inside the
letter class, longer than two characters and not a stop word.  Taking whole
``[\\p{L}\\p{N}_]+`` tokens first reproduces ``\\b...\\b`` semantics without
depending on the engine's notion of a word boundary (trap T-21).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# FIXED VALUES — these word lists must equal the reference's for keyword
# results to match.  Kept verbatim, in their original order, one language
# per string.  Duplicates across languages are harmless (set semantics).
# ---------------------------------------------------------------------------
_STOP_ENGLISH = """
i me my myself we our ours ourselves you your yours
yourself yourselves he him his himself she her hers herself
it its itself they them their theirs themselves what which
who whom this that these those am is are was were be
been being have has had having do does did doing a an
the and but if or because as until while of at by
for with about against between into through during before
after above below to from up down in out on off over
under again further then once can want need please would
could should shall will may might must here there when
where why how all each every both few more most other
some such no nor not only own same so than too very
just don now also well like get got go going went
come came make made take took give gave say said tell
told know knew think thought see saw look looked
"""
_STOP_SPANISH = """
el la los las un una unos unas de del en y o
que es no se lo con por para su al como pero si
me te le nos yo tu mi este esta esto ese esa
ser estar haber tener hacer poder decir ir ver dar
mas ya muy sin sobre entre cuando todo esta son tiene
"""
_STOP_FRENCH = """
le la les un une des du de et en est que qui
ne pas ce se il elle on nous vous ils je tu son
sa ses au aux avec pour sur dans par plus ou mais
si tout bien aussi comme peut fait etre avoir faire
"""
_STOP_GERMAN = """
der die das ein eine und ist ich du er sie es
wir ihr nicht den dem dem von zu mit auf fur an
bei nach uber auch aber oder wenn was wie hat bin
sind war wird kann muss soll noch schon nur sehr
"""
_STOP_PORTUGUESE = """
o a os as um uma de do da em no na e que
para com por se mais mas como ou tem ser ter foi
"""
_STOP_ITALIAN = """
il lo la i gli le di del della in e che non
un una per con su sono come ma anche ha ho questo
"""
_STOP_DUTCH = """
de het een van en in is dat op te met voor niet
zijn er maar ook aan om dit die dan wat nog wel
"""
# The older single-file variant (KW-2) uses only this English list.
_STOP_ENGLISH_SHORT = """
i me my myself we our ours ourselves you your yours
yourself yourselves he him his himself she her hers herself
it its itself they them their theirs themselves what which
who whom this that these those am is are was were be
been being have has had having do does did doing a an
the and but if or because as until while of at by
for with about against between into through during before
after above below to from up down in out on off over
under again further then once can want need please
"""
# END FIXED VALUES ----------------------------------------------------------


def _words(*blocks: str) -> list[str]:
    seen: dict[str, None] = {}
    for b in blocks:
        for w in b.split():
            seen.setdefault(w, None)
    return list(seen)


STOP_WORDS: list[str] = _words(_STOP_ENGLISH, _STOP_SPANISH, _STOP_FRENCH, _STOP_GERMAN,
                               _STOP_PORTUGUESE, _STOP_ITALIAN, _STOP_DUTCH)
STOP_WORDS_EN: list[str] = _words(_STOP_ENGLISH_SHORT)

# Token and class patterns (Java regex in Spark, RE2 in DuckDB; both accept them).
WORD_TOKEN = r"[\p{L}\p{N}_]+"
KW_CLASS_MULTI = "^[a-zA-ZÀ-ɏ]+$"   # KW-1
KW_CLASS_ASCII = "^[a-z]+$"                    # KW-2

# The characters Python's str.isspace() accepts, i.e. what str.strip() removes (T-5).
PY_WHITESPACE = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
                 "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
                 "\u2028\u2029\u202f\u205f\u3000")


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def py_strip(c) -> Column:
    """Python ``str.strip()``: removes Unicode white space, not only spaces (T-5).

    ``trim(BOTH set FROM c)`` only looks at the two ends, so a long text costs
    nothing extra (a ``$``-anchored regex would scan all of it).
    """
    return F.trim(_col(c), F.lit(PY_WHITESPACE))


def is_phrase(c) -> Column:
    """PF-1 on an already stripped cell: non-null, non-blank, not the text 'nan'."""
    c = _col(c)
    return c.isNotNull() & (c != "") & (F.lower(c) != "nan")


def keywords(c, variant: str = "multi") -> Column:
    """KW-1 (``variant='multi'``) / KW-2 (``'ascii'``): ordered keyword array, repeats kept."""
    c = _col(c)
    cls, stops = (KW_CLASS_MULTI, STOP_WORDS) if variant == "multi" else (KW_CLASS_ASCII, STOP_WORDS_EN)
    toks = F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(WORD_TOKEN), 0)
    # ``isin`` over many literals is planned as a hash-set lookup (InSet)
    return F.filter(toks, lambda t: (F.length(t) > 2) & ~t.isin(stops) & t.rlike(cls))


def truncate(c, n: int = 80) -> Column:
    """PF-8: first ``n`` characters plus '...' when longer."""
    c = _col(c)
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit("..."))).otherwise(c)


def prefix(c, n: int) -> Column:
    """PF-9: plain prefix."""
    return F.substring(_col(c), 1, n)


def sql_list(words: list[str]) -> str:
    """The stop list as a SQL list literal, for oracles and SQL users."""
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"
