"""Normalisation, tokens, passages and other scalar text functions as Column expressions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters and numerics that are no decimal digits.
TOKEN = r"[\p{L}\p{Nl}\p{No}]+"
MIN_PASSAGE_TOKENS = 5

# The Latin function words that results depend on.
LATIN_FUNCTION_WORDS = tuple(
    """a ab ac ad adhuc aliquid alius ante apud at atque aut autem circa contra cum cur de dum e enim ergo et etiam eius
    eorum eos ea eum ex eram erant erat ero erit est esse essent esset haec hanc hic his hoc iam ibi idem igitur ille illa
    illi illis illum in infra inter ita itaque ne nec neque nisi non nos noster nostra nostrum nunc per post pro propter
    quae quam quando qui quia quibus quod quorum quoque se sed seu sibi si sic sine sub sui sum sunt sua suum suus super
    tamen te tibi tu ubi uel uero ut vel vero vos vester vestra""".split()
)
#: Function words of the languages of modern corpora: a stop list for data that isn't Latin.
MODERN_FUNCTION_WORDS = tuple(
    "the of and to a in is that it for was on be as with by this are der die und den von zu das ist de la que el en y los le et les des une un".split()
)


@dataclass(frozen=True)
class Profile:
    """How text is normalised before it is read: composed, case folded, j as i, v as u, and without marks."""

    lower: bool = True
    j_to_i: bool = False
    v_to_u: bool = False
    strip_marks: bool = False


def half_up(x: Column, digits: int) -> Column:
    """Rounds halves up by a formula that all engines evaluate alike."""
    scale = float(10**digits)
    return F.floor(x * scale + 0.5) / scale


def trim_space(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def normalize_whitespace(text: Column) -> Column:
    """Paragraphs, split at blank lines, with runs of blanks and tabs made one space, joined by one blank line."""
    unix = F.regexp_replace(F.regexp_replace(text, "\r\n", "\n"), "\r", "\n")
    parts = F.transform(F.split(unix, r"(?U)\n\s*\n", -1), lambda p: trim_space(F.regexp_replace(p, "[ \t]+", " ")))
    return F.array_join(F.filter(parts, lambda p: p != ""), "\n\n")


def _icu(kind: str, method: str, text: Column, flag: bool) -> Column:
    """A string function of the ICU library, which Spark itself brings along, called in the JVM."""
    return F.reflect(F.lit(f"com.ibm.icu.{kind}"), F.lit(method), text, F.lit(flag))


def fold(text: Column, profile: Profile = Profile()) -> Column:
    """Composition, case and spelling by the profile, by Unicode's full rules; ASCII texts take the short way."""
    text = F.coalesce(text, F.lit(""))
    ascii_only = F.octet_length(text) == F.length(text)
    composed = _icu("text.Normalizer", "compose", text, False)
    full = _icu("lang.UCharacter", "foldCase", composed, True) if profile.lower else composed
    if profile.strip_marks:
        full = F.regexp_replace(_icu("text.Normalizer", "decompose", full, False), r"\p{Mn}", "")
    text = F.when(ascii_only, F.lower(text) if profile.lower else text).otherwise(full)
    if profile.j_to_i:
        text = F.translate(text, "jJ", "iI")
    return F.translate(text, "vV", "uU") if profile.v_to_u else text


def apply_profile(text: Column, profile: Profile = Profile(), one_line: bool = False) -> Column:
    """Folded text with normalised white space; ``one_line`` makes all of it single spaces."""
    folded = fold(text, profile)
    return trim_space(F.regexp_replace(folded, r"(?U)\s+", " ")) if one_line else normalize_whitespace(folded)


def tokenize(text: Column, profile: Profile = Profile()) -> Column:
    return F.regexp_extract_all(fold(text, profile), F.lit(TOKEN), F.lit(0))


def passages(text: Column) -> Column:
    """Passages of at least five tokens: at sentence ends, or at line ends where that gives fewer than two."""
    text = F.coalesce(text, F.lit(""))
    long = lambda p: F.size(F.regexp_extract_all(p, F.lit(TOKEN), F.lit(0))) >= MIN_PASSAGE_TOKENS
    cut = lambda pattern: F.filter(F.transform(F.split(text, pattern, -1), trim_space), long)
    first = cut(r"(?<=[.!?;:])\s+|\n{2,}")
    return F.when(F.size(first) >= 2, first).otherwise(cut(r"\n+|(?<=[.;])\s+"))


def trigrams(text: Column, profile: Profile = Profile()) -> Column:
    """Three-character grams of the one-line text, without blank ones."""
    # Arrays side by side, as a lambda would make the text anew for each of its characters.
    chars = F.split(apply_profile(text, profile, one_line=True), "", -1)
    size = F.greatest(F.size(chars), F.lit(1))
    pairs = F.zip_with(chars, F.slice(chars, F.lit(2), size), lambda a, b: F.concat(a, b))
    grams = F.zip_with(pairs, F.slice(chars, F.lit(3), size), lambda a, b: F.concat(a, b))
    return F.filter(grams, lambda g: g.isNotNull() & (F.trim(g) != ""))


def is_content(term: Column, stop_words: tuple[str, ...]) -> Column:
    return (F.length(term) > 2) & ~term.isin(*stop_words)


def units(text: Column) -> Column:
    """Runs of white space and of other characters, in turn."""
    return F.regexp_extract_all(text, F.lit(r"(?U)\s+|\S+"), F.lit(0))


def slug(text: Column) -> Column:
    return F.btrim(F.regexp_replace(text, "[^A-Za-z0-9_-]+", "_"), F.lit("_"))


def escape_html(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def number_label(value: Column, digits: int = 0) -> Column:
    """A number with points between thousands, from five digits on, and a decimal comma."""
    grouped = F.translate(F.format_number(F.coalesce(value, F.lit(0)), digits), ",.", ".,")
    small = F.abs(F.round(F.coalesce(value, F.lit(0)), digits)) < 10000
    return F.when(small, F.replace(grouped, F.lit("."), F.lit(""))).otherwise(grouped)


def highlight_families(text: Column, aliases: list[str]) -> Column:
    """Marks any alias, longest first, in any case and also within words."""
    import re

    found = "|".join(re.escape(a) for a in sorted(set(aliases), key=lambda a: (-len(a), a)))
    return F.regexp_replace(escape_html(text), rf"(?iu)({found})", "<mark>$1</mark>") if found else escape_html(text)


def highlight(text: Column, terms: list[str]) -> Column:
    """Marks whole-word occurrences of any term, longest first."""
    import re

    found = "|".join(re.escape(t) for t in sorted(set(terms), key=lambda t: (-len(t), t)))
    return F.regexp_replace(text, rf"(?iu)\b({found})\b", "<mark>$1</mark>") if found else text
