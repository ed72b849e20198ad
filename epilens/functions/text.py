"""Text normalisers and small text functions, column to column.

White space means the six ASCII characters. Accents are folded by a fixed map
of the composed Latin letters; what is left of non-ASCII text is dropped.
"""

from __future__ import annotations

import html
import json
from collections.abc import Callable
from html.entities import html5

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WS = r"[ \t\n\x0B\f\r]"
#: No ASCII word character stands before. As an alternative, (?:^|[^A-Za-z0-9_]), it takes six times as long on a text.
WORD_START = "(?<![A-Za-z0-9_])"


def starting(*words: str) -> str:
    """A pattern of the words where no ASCII word character stands before. The letters come first and the look back after
    them, so that a place of a text is passed over by its letter. words: patterns of fixed length."""
    return "(?:" + "|".join(f"{w}(?<={WORD_START}{w})" for w in words) + ")"


#: Composed Latin letters and their base letters.
ACCENTED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿāăąćĉċčďēĕėęěĝğġģĥĩīĭįĵķĺļľńņňōŏőŕŗřśŝşšţťũūŭůűųŵŷźżž"
PLAIN = "aaaaaaceeeeiiiinooooouuuuyyaaaccccdeeeeegggghiiiijklllnnnooorrrssssttuuuuuuwyzzz"
#: Ordered substring replacements of administrative words.
ADMIN_WORDS = [("kab.", "kabupaten"), ("kab ", "kabupaten "), ("kotamadya", "kota"), ("kodya", "kota"), ("prov.", "provinsi"), ("prov ", "provinsi "), ("dki", "dki jakarta"), ("di yogyakarta", "yogyakarta")]


def squeeze(c: Column) -> Column:
    """White space as single spaces, none at the ends. Spaces that stand alone are no matches: most of a text's are."""
    return F.trim(F.regexp_replace(c, rf"[\t\n\x0B\f\r]{WS}*| {WS}+", " "))


def each(kept: str) -> str:
    """A class with its letters and digits one by one.

    Ranges beside single characters make the matcher ask nested tests, over which the threads of an executor hold each other
    up: 700 to 870 ns a character on eight threads and 110 on one, 30 to 48 on eight if all are written out.
    """
    return kept.replace("a-z", "abcdefghijklmnopqrstuvwxyz").replace("0-9", "0123456789")


def only(c: Column, kept: str) -> Column:
    """The runs of kept characters with single spaces between, by one match for each gap."""
    return F.trim(F.regexp_replace(c, f"[^{each(kept)}]+", " "))


def is_ascii(c: Column) -> Column:
    return F.octet_length(c) == F.char_length(c)


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(" \t\n\x0b\f\r"))


def fold(c: Column) -> Column:
    low = F.lower(c)
    return F.when(is_ascii(low), low).otherwise(F.regexp_replace(F.translate(low, ACCENTED, PLAIN), r"[^\x00-\x7F]+", ""))


def region_code(c: Column) -> Column:
    c = F.regexp_replace(fold(c), "[^" + each(r"a-z0-9 \t\n\x0B\f\r/_-") + "]+", "")
    return F.btrim(F.regexp_replace(c, r"[ \t\n\x0B\f\r/_-]+", "_"), F.lit("_"))


def alias_form(c: Column) -> Column:
    return only(F.replace(fold(c), F.lit("/"), F.lit(" ")), "a-z0-9.-")


def resolver_key(c: Column) -> Column:
    c = F.replace(F.lower(strip(c)), F.lit("&"), F.lit(" dan "))
    c = F.when(F.contains(c, F.lit("provinsi")), F.regexp_replace(c, "(^|[^a-z0-9_])provinsi($|[^a-z0-9_])", "$1$2")).otherwise(c)
    return F.btrim(F.regexp_replace(c, "[^a-z0-9]+", "_"), F.lit("_"))


def search_text(c: Column) -> Column:
    return only(F.replace(F.lower(c), F.lit("&"), F.lit(" dan ")), "a-z0-9")


def dedup_text(c: Column) -> Column:
    return only(F.regexp_replace(F.lower(c), r"https?://[^ \t\n\x0B\f\r]+", " "), "a-z0-9")


def title_text(c: Column) -> Column:
    return only(F.lower(c), "a-z0-9")


def gazetteer_form(c: Column) -> Column:
    c = F.lower(squeeze(c))
    for old, new in ADMIN_WORDS:
        c = F.replace(c, F.lit(old), F.lit(new))
    return only(c, "a-z0-9-")


def match_text(c: Column) -> Column:
    return only(F.lower(c), "a-z0-9-")


def publisher_alias(c: Column) -> Column:
    return only(F.lower(c), "a-z0-9.-")


def import_key(c: Column) -> Column:
    return F.replace(search_text(c), F.lit(" "), F.lit("_"))


def slug(c: Column, default: str) -> Column:
    """ASCII letters, digits and _ in lower case, with - for the gaps between. What the first match leaves of other letters goes
    with it, and white space at the ends becomes - and is trimmed, so two matches do."""
    c = F.regexp_replace(F.translate(F.lower(c), ACCENTED, PLAIN), r"[^a-z0-9_ \t\n\x0B\f\r-]+", "")
    c = F.btrim(F.regexp_replace(c, r"[ \t\n\x0B\f\r-]+", "-"), F.lit("-_"))
    return F.coalesce(F.nullif(c, F.lit("")), F.lit(default))


def truncate(c: Column, n: int, suffix: str = "...") -> Column:
    """The first n characters without trailing white space, and the suffix, if the text is longer; n <= 0 is off."""
    return c if n <= 0 else F.when(F.length(c) > n, F.concat(F.regexp_replace(F.left(c, F.lit(n)), f"{WS}+$", ""), F.lit(suffix))).otherwise(c)


def headline(c: Column) -> tuple[Column, Column]:
    """Title and publisher around the last ' - '; without one, the text and ''."""
    tail = F.substring_index(c, " - ", -1)
    has = F.contains(c, F.lit(" - "))
    return F.when(has, F.left(c, F.length(c) - F.length(tail) - 3)).otherwise(c), F.when(has, tail).otherwise(F.lit(""))


def sentences(c: Column, least: int = 25) -> Column:
    """Pieces after . ! ? and white space that are longer than least."""
    return single_spaced(squeeze(c), least)


def single_spaced(c: Column, least: int = 25) -> Column:
    """The sentences of a text whose white space is single spaces; one at its end, where it was cut, belongs to the last."""
    return F.filter(F.split(c, r"(?<=[.!?]) "), lambda x: F.length(x) > least)


def listed(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, r"[\n,;]+"), lambda x: strip(x)), lambda x: x != "")


def numbers(c: Column) -> Column:
    """Runs of digits that stand alone among ASCII word characters."""
    return F.regexp_extract_all(F.concat(F.lit(" "), F.regexp_replace(c, r"[^0-9A-Za-z_]", "  "), F.lit(" ")), F.lit(" ([0-9]+) "), 1)


def strip_admin(c: Column) -> Column:
    """Without a leading province, city or regency word."""
    return F.regexp_replace(F.lower(strip(c)), r"^(kab\.|kabupaten|kota|provinsi|prov\.)[ \t\n\x0B\f\r]*", "")


def distinct_folded(c: Column) -> Column:
    """Items distinct by trimmed lower case, the first spelling kept, in order."""
    items = F.filter(F.transform(c, lambda x: strip(x)), lambda x: x != "")
    folded = F.transform(items, lambda x: F.lower(x))
    return F.filter(items, lambda x, i: F.array_position(folded, F.lower(x)) == i + 1)


def first_of_each(rows: DataFrame, items: Column, key: Callable[[Column], Column], name: str) -> DataFrame:
    """rows with the items of which none before has the same key, in order, as a column.

    The keys are a column of their own: an expression inside a lambda is computed for every item.
    """
    rows = rows.withColumn("_keyed", F.transform(items, lambda x: F.struct(x.alias("item"), key(x).alias("key"))))
    first = F.filter("_keyed", lambda x, i: F.array_position(F.col("_keyed.key"), x["key"]) == i + 1)
    return rows.withColumn(name, F.transform(first, lambda x: x["item"])).drop("_keyed")


#: Numbers below 256 whose reference is not the character of that code: controls and the Windows letters.
_ODD_CODES = {str(i): html.unescape(f"&#{i};") for i in range(256) if html.unescape(f"&#{i};") != chr(i)}


def unescape(c: Column) -> Column:
    """The text with its character references decoded as HTML 5 says: all names, with and without semicolon, and numbers.

    The standard's tables are two literal maps; a text is cut before each ampersand and only what follows one is looked up.
    """
    names = F.from_json(F.lit(json.dumps(html5)), "map<string,string>")
    odd = F.from_json(F.lit(json.dumps(_ODD_CODES)), "map<string,string>")

    def decoded(piece: Column) -> Column:
        token = F.regexp_extract(piece, r"^&(#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)", 1)
        rest = F.substring(piece, F.length(token) + 2, F.length(piece))
        digits = F.regexp_replace(F.rtrim(token, F.lit(";")), "^#[xX]?0*", "")
        is_hex = F.lower(F.substring(token, 2, 1)) == "x"
        large = F.length(digits) > F.when(is_hex, 6).otherwise(7)
        code = F.when(large, F.lit(1 << 30)).when(digits == "", F.lit(0)).otherwise(F.when(is_hex, F.conv(digits, 16, 10)).otherwise(digits).cast("long"))
        code = code.cast("long")
        none = ((code >= 0xFDD0) & (code <= 0xFDEF)) | (code.bitwiseAND(F.lit(0xFFFE)) == 0xFFFE)
        letter = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
        number = F.when((code > 0x10FFFF) | ((code >= 0xD800) & (code <= 0xDFFF)), F.lit("\ufffd")).when(F.map_contains_key(odd, code.cast("string")), odd[code.cast("string")]).when(none, "").otherwise(letter)
        # A name without its semicolon may have letters of the text behind it.
        short = [F.when(F.length(token) > n, F.concat(names[F.left(token, F.lit(n))], F.substring(token, n + 1, 40))) for n in range(6, 1, -1)]
        named = F.coalesce(names[token], *short, F.concat(F.lit("&"), token))
        return F.when(token == "", piece).when(F.startswith(token, F.lit("#")), F.concat(number, rest)).otherwise(F.concat(named, rest))

    return F.when(F.contains(c, F.lit("&")), F.array_join(F.transform(F.split(c, "(?=&)"), decoded), "")).otherwise(c)
