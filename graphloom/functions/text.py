"""Answer normalisation, name splitting and token helpers as Column expressions.

Everything here stays inside the JVM. The accent/punctuation table that Spark
has no built-in for is derived from the Unicode database once per process and
shipped as one literal to ``translate``.
"""

from __future__ import annotations

import sys
import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- fixed values -----------------------------------------------------------
#: Number words mapped to their position.
NUMBER_WORDS = (
    "zero one two three four five six seven eight nine ten eleven twelve thirteen "
    "fourteen fifteen sixteen seventeen eighteen nineteen twenty"
).split()
#: Surname particles after which an inner capital does not start a new person.
NAME_PARTICLES = ("Mac", "Mc", "Van", "Di", "De", "Le", "La")
#: Separators of a written list of names.
LIST_SEPARATORS = r"(?U)\s*(?:,|;|&|\band\b)\s*"
#: Apostrophes that join a word instead of separating it.
APOSTROPHES = "['’ʼ`]"
#: Words that never count as shared content.
OVERLAP_STOPWORDS = ("the", "a", "an", "of", "in", "at", "is", "was", "did")
# -----------------------------------------------------------------------------

_MARK = "\u0001"
_BOUNDARY = (
    r"(?<=\p{IsLowercase})(?<!" + "|".join(NAME_PARTICLES) + r")(?=\p{IsUppercase})"
)
#: Every white space character of the Basic Multilingual Plane.
_SPACES = "".join(chr(c) for c in range(0x10000) if chr(c).isspace())
#: The same as the inside of a character class.
SPACES = r"\t-\r\x1C-\x20\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"


def let(value: Column, body) -> Column:
    """``body`` of ``value`` with the value computed once.

    A lambda re-evaluates the expressions it captures for every element; bound
    to a lambda variable they are evaluated a single time.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def _is_surrogate(code: int) -> bool:
    return 0xD800 <= code <= 0xDFFF


@lru_cache(maxsize=1)
def _fold_tables() -> tuple[str, str, dict[str, str]]:
    """(characters, replacements, expansions) of the folding rule.

    The rule: compatibility-decompose, drop non-spacing marks, turn every
    punctuation character into a space. Characters whose result is a single
    character feed ``translate``; those that vanish come last, where
    ``translate`` deletes them; the rest (ligatures, fractions, ...) are listed
    as expansions, Hangul syllables among them.
    """
    single, gone, expand = {}, [], {}
    for code in range(1, sys.maxunicode + 1):
        if _is_surrogate(code):
            continue
        ch = chr(code)
        kept = [
            " " if unicodedata.category(c).startswith("P") else c
            for c in unicodedata.normalize("NFKD", ch)
            if unicodedata.category(c) != "Mn"
        ]
        folded = "".join(kept)
        if folded == ch:
            continue
        if not folded:
            gone.append(ch)
        elif len(folded) == 1:
            single[ch] = folded
        else:
            expand[ch] = folded
    source = "".join(single) + "".join(gone)
    return source, "".join(single.values()), expand


@lru_cache(maxsize=1)
def _expansion_class() -> str:
    """A character class around the expandable characters.

    It may admit more than those (the expansion leaves others alone); few wide
    ranges keep the test cheap for every text that has none.
    """
    spans: list[list[int]] = []
    for code in sorted(ord(c) for c in _fold_tables()[2]):
        gap = 2 if code < 0x2100 else 512
        if spans and code - spans[-1][1] <= gap:
            spans[-1][1] = code
        else:
            spans.append([code, code])
    return "[" + "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in spans) + "]"


def fold(text: Column) -> Column:
    """Accents off, every Unicode punctuation mark to a space."""
    source, target, expand = _fold_tables()
    pairs = "\u0002".join(f"{k}\u0003{v}" for k, v in expand.items())
    table = F.str_to_map(F.lit(pairs), F.lit("\u0002"), F.lit("\u0003"))

    def expanded(t: Column) -> Column:
        # Few distinct characters of a text expand: each is replaced once.
        found = F.array_distinct(F.regexp_extract_all(t, F.lit(f"({_expansion_class()})"), F.lit(1)))
        replaced = F.aggregate(
            found, t, lambda done, c: F.replace(done, c, F.coalesce(F.element_at(table, c), c))
        )
        return F.when(t.rlike(_expansion_class()), replaced).otherwise(t)

    return F.translate(let(text, expanded), source, target)


def strip(text: Column) -> Column:
    """Trim Unicode white space on both ends."""
    return F.btrim(text, F.lit(_SPACES))


def squash(text: Column) -> Column:
    """Collapse white space runs and trim."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def _canonical(token: Column) -> Column:
    words = F.array(*[F.lit(w) for w in NUMBER_WORDS])
    at = F.array_position(words, token)
    return (
        F.when(at > 0, (at - 1).cast("string"))
        .when(token.between("0", "9:") & token.rlike("^[0-9]+$"), F.regexp_replace(token, "^0+(?=[0-9])", ""))
        .otherwise(token)
    )


def canonical_token(token: Column) -> Column:
    """Number words up to twenty become digits; leading zeros go."""
    return _canonical(token)


def _plain(text: Column, mark: str = "") -> Column:
    """Lower case, folded, without articles, for ``_words``; a text of ASCII letters, digits, blanks and ``mark`` leaves its articles to that."""
    lowered = F.regexp_replace(F.lower(text), APOSTROPHES, "")

    def rest(t: Column) -> Column:
        bare = F.regexp_replace(fold(t), r"(?U)\b(a|an|the)\b", " ")
        # Anchored and possessive: searching for a character outside the class takes many times longer.
        return F.when(t.rlike(rf"^[0-9A-Za-z {mark}]*+\z"), t).otherwise(F.regexp_replace(bare, r"(?U)\s+", " "))

    # Punctuation folds to blanks, whose number does not matter here.
    return let(F.regexp_replace(lowered, r"\p{P}+", " "), rest)


def _words(text: Column) -> Column:
    return F.transform(F.filter(F.split(text, " "), lambda t: ~t.isin("", "a", "an", "the")), _canonical)


def normalize_answer(text: Column) -> Column:
    """Lower case, no accents/punctuation/articles, canonical numbers, single spaces."""
    return F.array_join(_words(_plain(F.coalesce(text, F.lit("")))), " ")


def split_people(text: Column) -> Column:
    """Split names written without a separator ("Jane SmithJohn Doe")."""
    pieces = F.transform(F.split(F.coalesce(text, F.lit("")), _BOUNDARY), strip)
    return F.filter(pieces, lambda p: p != "")


def split_names(text: Column) -> Column:
    """Split on list separators and on concatenation boundaries."""
    marked = F.regexp_replace(F.coalesce(text, F.lit("")), LIST_SEPARATORS, _MARK)
    marked = F.regexp_replace(marked, _BOUNDARY, _MARK)
    return F.filter(F.transform(F.split(marked, _MARK), strip), lambda p: p != "")


def _name_parts(text: Column) -> Column:
    # One pass over the whole string keeps the regex work in generated code;
    # the mark survives normalisation and separates the names afterwards.
    marked = F.regexp_replace(F.coalesce(text, F.lit("")), LIST_SEPARATORS, _MARK)
    marked = F.regexp_replace(marked, _BOUNDARY, _MARK)
    return F.split(_plain(marked, _MARK), _MARK)


def answer_parts(text: Column) -> Column:
    """array<array<string>>: the normalised words of each name in an answer."""
    return F.transform(_name_parts(text), _words)


def names_of(parts: Column) -> Column:
    """Distinct normalised names out of ``answer_parts``."""
    joined = F.transform(parts, lambda words: F.array_join(words, " "))
    return F.array_distinct(F.filter(joined, lambda n: n != ""))


def numbers_of(parts: Column) -> Column:
    """Distinct numbers stated in an answer (splitting names never touches digits)."""
    return F.array_distinct(F.filter(F.flatten(parts), lambda t: t.rlike("^[0-9]+$")))


def normalized_names(text: Column) -> Column:
    """Distinct normalised names of an answer."""
    return names_of(answer_parts(text))


def answer_tokens(text: Column) -> Column:
    """Normalised tokens over the answer's names (with repeats)."""
    return F.flatten(answer_parts(text))


def is_count(names: Column) -> Column:
    """A name set that is one bare number."""
    return (F.size(names) == 1) & F.coalesce(F.try_element_at(names, F.lit(1)).rlike("^[0-9]+$"), F.lit(False))


def word_set(text: Column) -> Column:
    """Distinct lower-case word tokens."""
    return F.array_distinct(
        F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"(?U)(\w+)"), F.lit(1))
    )


def date_words(text: Column) -> Column:
    """Words of a text, used to find a quoted date inside a question."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"(?U)[^\w]+", " "))


def event_part(title: Column, any_case: bool = False) -> Column:
    """The event part of a page title, NULL when the title has none."""
    pattern = "(?i)" + EVENT_TITLE if any_case else EVENT_TITLE
    return F.nullif(F.regexp_extract(title, pattern, 1), F.lit(""))


def event_id(sport: Column, games: Column, event: Column) -> Column:
    """Composite event id; ``event`` may be a whole page title. NULL when a part is."""
    named = F.coalesce(event_part(event, any_case=True), event)
    return F.when(
        sport.isNotNull() & games.isNotNull() & event.isNotNull(),
        F.concat_ws("-", slug(sport), games, slug(named)),
    )


# ---- fixed values -----------------------------------------------------------
#: Separator between the edition and the event in a page title.
EVENT_TITLE = r"Olympics\s*[–—−-]\s*(.+)$"
# -----------------------------------------------------------------------------


def slug(text: Column) -> Column:
    """Lower-case hyphen slug; a plus sign is kept as a word."""
    plussed = F.replace(F.lower(text), F.lit("+"), F.lit(" plus "))
    return F.regexp_replace(F.regexp_replace(plussed, "[^a-z0-9]+", "-"), "^-+|-+$", "")


def clean_title(title: Column, limit: int = 80) -> Column:
    """White space collapsed, cut to ``limit`` characters, NULL when empty."""
    return F.nullif(F.substring(squash(F.coalesce(title, F.lit(""))), 1, limit), F.lit(""))


def loose(text: Column) -> Column:
    """Vocabulary comparison form: dashes and underscores are spaces, lower case."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), "[-–—_]", " "), r"(?U)\s+", " "))


def question_form(text: Column) -> Column:
    """Comparison form for spans that must occur in the question."""
    plain = F.translate(F.coalesce(text, F.lit("")), "’–", "'-")
    return squash(F.lower(plain))


def table_answer_form(text: Column) -> Column:
    """The results table's own, simpler form, used only to detect disagreement."""
    quoted = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[‘’]", "'")
    bare = F.regexp_replace(quoted, r"\b(a|an|the)\b", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, r"[^A-Za-z0-9_\s']", " "), r"\s+", " "))
