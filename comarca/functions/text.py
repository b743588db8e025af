"""Text expressions. All of them stay on the JVM; no Python function runs per row."""

from __future__ import annotations

import json
import sys
import unicodedata
from collections.abc import Callable
from functools import lru_cache
from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters ``strip`` removes at both ends, derived from the Unicode property.
WHITESPACE = "".join(chr(point) for point in range(0x3001) if chr(point).isspace())

_NON_ASCII = r"[^\x00-\x7F]"
_LATIN_MARKS = range(0x0300, 0x0370)
_HANGUL_SYLLABLES = range(0xAC00, 0xD7A4)


def strip(text: Column) -> Column:
    """Drop white space of any kind at both ends (Spark's ``trim`` knows blanks only)."""
    return F.btrim(text, F.lit(WHITESPACE))


def quoted(text: str) -> str:
    """A SQL string literal. Long column lists are built as SQL text, one call per column."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def strip_sql(text: str) -> str:
    """:func:`strip` for SQL text."""
    return f"btrim({text}, {quoted(WHITESPACE)})"


def is_blank(text: Column) -> Column:
    return F.coalesce(strip(text.cast("string")), F.lit("")) == ""


def zero_fill(code: Column, width: int = 2) -> Column:
    """Left-pad with zeros, never cutting a longer code; a sign stays in front."""
    text = code.cast("string")
    sign = F.regexp_extract(text, "^[+-]", 0)
    digits = F.substring(text, F.length(sign) + 1, F.length(text))
    padded = F.concat(sign, F.lpad(digits, F.lit(width) - F.length(sign), F.lit("0")))
    return F.when(F.length(text) >= width, text).otherwise(padded)


def _to_ascii(char: str) -> str:
    return unicodedata.normalize("NFKD", char).encode("ascii", "ignore").decode()


def _without_latin_marks(char: str) -> str:
    if ord(char) in _HANGUL_SYLLABLES:
        return char
    return "".join(c for c in unicodedata.normalize("NFD", char) if ord(c) not in _LATIN_MARKS)


@lru_cache(maxsize=None)
def _mapping(rule: Callable[[str], str]) -> tuple[str, str, dict[str, str]]:
    """Tabulate ``rule`` over Unicode as two ``translate`` strings and a map of longer results."""
    sources, targets, deleted, longer = [], [], [], {}
    for point in range(0x80, sys.maxunicode + 1):
        if 0xD800 <= point <= 0xDFFF:
            continue
        char = chr(point)
        mapped = rule(char)
        if mapped == char:
            continue
        if len(mapped) == 1:
            sources.append(char)
            targets.append(mapped)
        elif mapped:
            longer[char] = mapped
        elif ord(char) in _LATIN_MARKS:
            deleted.append(char)
    return "".join(chain(sources, deleted)), "".join(targets), longer


def _map_characters(text: Column, rule: Callable[[str], str]) -> Column:
    """Apply a character rule: first one-to-one characters, then the few that become several."""
    sources, targets, longer = _mapping(rule)
    table = F.from_json(F.lit(json.dumps(longer)), "map<string,string>")

    def expanded(part: Column) -> Column:
        # Only characters that the table has: a text in another script has many that map to themselves.
        left = F.array_intersect(F.regexp_extract_all(part, F.lit(f"({_NON_ASCII})"), F.lit(1)), F.map_keys(table))
        return F.aggregate(left, part, lambda done, char: F.replace(done, char, F.try_element_at(table, char)))

    # Mapped text is bound to a variable: what is left outside ASCII is usually nothing.
    mapped = F.transform(
        F.array(F.translate(text, sources, targets)), lambda part: F.when(part.rlike(_NON_ASCII), expanded(part)).otherwise(part)
    )[0]
    return F.when(text.rlike(_NON_ASCII), mapped).otherwise(text)


def fold(text: Column) -> Column:
    """Lower case, stripped, compatibility-decomposed and reduced to ASCII; null gives ``''``."""
    lowered = strip(F.lower(F.coalesce(text.cast("string"), F.lit(""))))
    return F.regexp_replace(_map_characters(lowered, _to_ascii), _NON_ASCII, "")


def unaccent(text: Column) -> Column:
    """Canonically decomposed without Latin accents, lower case, stripped; other letters stay."""
    return strip(F.lower(_map_characters(text.cast("string"), _without_latin_marks)))


def slug(text: Column) -> Column:
    """Lower-case words of ``a-z0-9`` joined by single underscores."""
    return F.btrim(F.regexp_replace(unaccent(text), "[^a-z0-9]+", "_"), F.lit("_"))


def title_words(text: Column) -> Column:
    """Upper-case the first letter of every blank-separated word and squeeze the blanks."""
    words = F.filter(F.split(text, " "), lambda word: word != "")
    return F.array_join(F.transform(words, _capital_first), " ")


def title_runs(text: Column) -> Column:
    """Capitalise every run of letters, so a letter after a digit or a sign is a capital too."""
    runs = F.split(text, r"(?<=[^\p{L}])")
    return F.array_join(
        F.transform(runs, lambda run: F.concat(F.upper(F.substring(run, 1, 1)), F.lower(F.substring(run, 2, 1 << 30)))),
        "",
    )


def _capital_first(word: Column) -> Column:
    return F.concat(F.upper(F.substring(word, 1, 1)), F.substring(word, 2, 1 << 30))


def aliased(key: Column, aliases: list[tuple[str, str]], otherwise: Column) -> Column:
    """Look a key up in a short alias list (a literal map), falling back to ``otherwise``."""
    table = F.create_map(*[F.lit(item) for item in chain.from_iterable(dict(aliases).items())])
    return F.coalesce(F.try_element_at(table, key), otherwise)


def canonical_name(text: Column, aliases: list[tuple[str, str]]) -> Column:
    """Entity name: the alias of the unaccented text, else the text in title case."""
    key = unaccent(text)
    return aliased(key, aliases, title_words(key))


def canonical_variable(text: Column, aliases: list[tuple[str, str]]) -> Column:
    """Variable id: the alias of the unaccented text, else its slug."""
    key = unaccent(text)
    return aliased(key, aliases, slug(key))


def fill_in(template: str, **values: Column | str) -> Column:
    """A sentence with ``{name}`` replaced by columns or texts."""
    pieces: list[Column] = []
    rest = template
    while rest:
        before, brace, tail = rest.partition("{")
        if before:
            pieces.append(F.lit(before))
        if not brace:
            break
        name, _, rest = tail.partition("}")
        value = values[name]
        pieces.append(value.cast("string") if isinstance(value, Column) else F.lit(value))
    return F.concat(*pieces)
