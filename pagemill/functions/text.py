"""Scalar text functions as Column expressions; Python only where no built-in has the semantics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagemill.functions.core import let

#: Apostrophe-like marks that Uzbek writes as one letter, and that letter.
APOSTROPHES, TURNED_COMMA = "’'ʼ", "ʻ"
#: Vowels of the de-hyphenation rule, and endings that keep their hyphen.
VOWELS = "аеёиоуыэюяaeiou"
KEPT_ENDINGS = ("-то", "-либо", "-нибудь", "-ка", "-таки", "ко-", "из-за", "из-под")
#: Markers in names of formula fonts.
MATH_FONTS = ("cambriamath", "stix", "latinmodernmath", "asanamath", "xitsmath", "cmmi", "cmex", "cmsy", "msam", "msbm", "eufm", "eurb", "esint", "rsfs", "math")
#: Code point ranges with many formula characters.
MATH_RANGES = (
    (0x2200, 0x22FF), (0x2A00, 0x2AFF), (0x27C0, 0x27EF), (0x2980, 0x29FF), (0x1D400, 0x1D7FF),
    (0x2100, 0x214F), (0x2070, 0x209F), (0x2030, 0x205E), (0x00B0, 0x00BF), (0xFB00, 0xFB4F),
)
MATH_SHARE = 0.15
#: Short words that a no-break space ties to the next word.
SHORT_WORDS = (
    "в", "на", "с", "к", "под", "о", "об", "от", "до", "по", "за", "из", "у", "или", "и", "а", "но", "да", "не", "ни",
    "без", "для", "над", "перед", "при", "про", "через", "сквозь",
)
#: Codes of the translation model, by language and script.
LANGUAGE_CODES = {"ru": "rus_Cyrl", "uz": "uzn_Latn"}
LANGUAGE_CODES_CYRILLIC = {"ru": "rus_Cyrl", "uz": "uzn_Cyrl"}
#: List markers, tried in this order.
MARKERS = (r"^\s*[\x{2022}\x{2023}\x{25E6}\x{2043}\x{2219}]\s*", r"^\s*(?:\d{1,3}[.)]|[a-zA-Z][.)])\s*", r"^\s*[-*]\s*")


def canonical_apostrophes(text: Column) -> Column:
    return F.translate(text, APOSTROPHES, TURNED_COMMA * len(APOSTROPHES))


def nfkc(text: Column) -> Column:
    """Unicode compatibility composition. Spark has no built-in; one Arrow batch at a time."""

    @F.pandas_udf("string")
    def run(column):
        import unicodedata

        return column.map(lambda s: None if s is None else unicodedata.normalize("NFKC", s))

    return run(text)


def normalize(text: Column, source: Column | str) -> Column:
    """Canonical apostrophes for Uzbek, then NFKC for all."""
    source = F.lit(source) if isinstance(source, str) else source
    return nfkc(F.when(source == "uz", canonical_apostrophes(text)).otherwise(text))


def source_language(target: Column) -> Column:
    return F.when(target == "ru", F.lit("uz")).otherwise(F.lit("ru"))


def language_code(language: Column, cyrillic: bool = False) -> Column:
    """The model's code; an unknown language is an error."""
    table = LANGUAGE_CODES_CYRILLIC if cyrillic else LANGUAGE_CODES
    codes = F.create_map(*(F.lit(x) for pair in table.items() for x in pair))
    found = F.element_at(codes, language)
    return F.when(found.isNull(), F.raise_error(F.concat(F.lit("unsupported language: "), F.coalesce(language, F.lit("null"))))).otherwise(found)


def first_of(*options: tuple[Column, Column], otherwise: Column) -> Column:
    """Value of the first condition that holds."""
    out = F.when(*options[0])
    for condition, value in options[1:]:
        out = out.when(condition, value)
    return out.otherwise(otherwise)


def strip_ends(text: Column) -> Column:
    return F.regexp_replace(text, r"^(?U)\s+|(?U)\s+$", "")


def list_marker(text: Column) -> Column:
    """The trimmed list marker of a line, or null."""
    return first_of(*((F.rlike(text, F.lit(p)), strip_ends(F.regexp_extract(text, p, 0))) for p in MARKERS), otherwise=F.lit(None).cast("string"))


def without_marker(text: Column) -> Column:
    """The line after its list marker, trimmed; a line without one as it is."""
    return first_of(*((F.rlike(text, F.lit(p)), strip_ends(F.regexp_replace(text, p, ""))) for p in MARKERS), otherwise=text)


def with_marker(text: Column, marker: Column) -> Column:
    return F.when(marker.isNull(), text).otherwise(F.concat(marker, F.lit(" "), text))


def _is_vowel(char: Column) -> Column:
    return F.instr(F.lit(VOWELS), F.lower(char)) > 0


def hyphen_core(line: Column) -> Column:
    """A line without its trailing hyphen and what space follows it."""
    return F.regexp_replace(line, r"-\s*$", "")


def left_stripped(line: Column) -> Column:
    return F.regexp_replace(line, r"^\s+", "")


def joins_next(line: Column, following: Column) -> Column:
    """Does the trailing hyphen of ``line`` only break a word that ``following`` goes on?

    It does if exactly one of the letters around it is a vowel; dashes and fixed
    endings keep theirs.
    """
    core, rest = hyphen_core(line), left_stripped(following)
    before, after = F.right(core, F.lit(1)), F.left(rest, F.lit(1))
    trimmed = F.regexp_replace(line, r"\s+$", "")
    kept = F.exists(F.array(*map(F.lit, KEPT_ENDINGS)), lambda e: F.endswith(trimmed, e))
    ok = F.rlike(line, F.lit(r"-\s*$")) & (F.length(core) > 0) & (F.length(rest) > 0) & ~before.isin("—", "–") & ~kept
    return F.coalesce(ok & (_is_vowel(before) != _is_vowel(after)), F.lit(False))


def is_math_font(font: Column) -> Column:
    name = F.translate(F.substring_index(F.lower(F.coalesce(font, F.lit(""))), "+", -1), " -_", "")
    return F.exists(F.array(*map(F.lit, MATH_FONTS)), lambda m: F.contains(name, m))


def math_share(text: Column) -> Column:
    """Share of code points in the formula ranges; 0 for an empty text."""
    ranges = "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in MATH_RANGES)
    n = F.length(F.regexp_replace(text, f"[^{ranges}]", ""))
    return F.when(F.length(text) > 0, n / F.length(text)).otherwise(F.lit(0.0))


def has_math_unicode(text: Column) -> Column:
    return math_share(text) >= MATH_SHARE


def _title(text: Column) -> Column:
    """Every letter after a non-letter upper, the others lower."""

    def cased(chars: Column) -> Column:
        return F.transform(chars, lambda c, i: F.when((i == 0) | ~F.rlike(F.get(chars, i - 1), F.lit(r"\p{L}")), F.upper(c)).otherwise(F.lower(c)))

    return F.array_join(let(F.split(text, ""), cased), "")


def is_upper(text: Column) -> Column:
    return (F.upper(text) == text) & (F.lower(text) != text)


def is_title(text: Column) -> Column:
    """Capitals exactly where words begin, and at least one cased letter."""
    return F.rlike(text, F.lit(r"\p{Lu}")) & ~F.rlike(text, F.lit(r"(?<!\p{L})\p{Ll}")) & ~F.rlike(text, F.lit(r"\p{L}\p{Lu}"))


def restore_case(original: Column, translated: Column) -> Column:
    """Gives a translation the case pattern of its original."""
    first = F.left(original, F.lit(1))
    capital = F.concat(F.upper(F.left(translated, F.lit(1))), F.substr(translated, F.lit(2)))
    blank = original.isNull() | translated.isNull() | (original == "") | (translated == "")
    return first_of((blank, translated), (is_upper(original), F.upper(translated)), (is_title(original), _title(translated)), (is_upper(first), capital), otherwise=translated)


def russian_typography(text: Column) -> Column:
    """Guillemets, curly single quotes, and no-break spaces after short words."""
    out = F.regexp_replace(text, r'"([^"]*)"', "«$1»")
    out = F.regexp_replace(out, r"'([^']*)'", "‘$1’")
    return F.regexp_replace(out, rf"(?U)\b({'|'.join(SHORT_WORDS)})\s+(?=\S)", "$1\u00a0")


def cache_key(source: Column, target: Column, text: Column, glossary: Column | None = None) -> Column:
    """MD5 of languages, trimmed NFKC text and glossary. ``text`` is given in NFKC."""
    glossary = F.lit(None).cast("string") if glossary is None else glossary
    return F.md5(F.concat_ws("|", source, target, F.trim(text), F.coalesce(glossary, F.lit("null"))).cast("binary"))


def tokens(text: Column) -> Column:
    """Words between white space; none for a blank text."""
    return F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")


def char_overlap(source: Column, back: Column) -> Column:
    """Share of the source's distinct characters, lowered, that the back-translation has too."""
    a, b = (F.array_distinct(F.filter(F.split(F.lower(x), ""), lambda c: c != "")) for x in (source, back))
    share = lambda p: F.when(F.size(p["a"]) > 0, F.size(F.array_intersect(p["a"], p["b"])) / F.size(p["a"])).otherwise(F.lit(0.0))
    return let(F.struct(a.alias("a"), b.alias("b")), share)


def replace_all(text: Column, entries: Column, old: str, new: str) -> Column:
    """Replaces ``old`` by ``new`` of every entry (array of structs), one after the other."""
    return F.aggregate(entries, text, lambda t, e: F.replace(t, e[old], e[new]))


def keyword_list(words: Sequence[str]) -> Column:
    return F.array(*map(F.lit, words))
