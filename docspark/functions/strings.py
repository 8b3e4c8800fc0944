"""Column functions over text, codes and paths."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

NAMESPACE_URL = "6ba7b8119dad11d180b400c04fd430c8"
NAMESPACE_DNS = "6ba7b8109dad11d180b400c04fd430c8"
WHITE = r"[\s\p{Z}\x{85}\x{1c}-\x{1f}]"  # a pattern of white space, beyond ASCII too


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """`f` of a value that is computed once a row, however often `f` names it, in functions over arrays too. Columns of a
    table have `sources.shared.once`; this is for parts of one expression."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def uuid5(name: Column, namespace: str = NAMESPACE_URL) -> Column:
    """Name-based UUID (version 5) by SHA-1, as a Catalyst expression."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace)), F.encode(name, "UTF-8")))
    variant = F.element_at(F.array(*map(F.lit, "89ab")), (F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4 + 1).cast("int"))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))


def canonical_sha(entries: Column) -> Column:
    """SHA-256 of a map's entries in key order."""
    return F.sha2(F.array_join(F.transform(F.array_sort(F.map_entries(entries)), lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit("")))), "\n"), 256)


def clean_title(col: Column) -> Column:
    """Without a trailing ` - http…` address."""
    return F.trim(F.regexp_replace(col, r"\s+-\s+https?://\S*\s*$", ""))


def normalize_title(col: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(col)), r"\s+", " ")


def relative_path(path: Column, source: Column) -> Column:
    """From `/<source>/pdfs/` or `/<source>/cache/` on, else from `/data/` on, with doubled `data/` collapsed."""
    inner = F.regexp_extract(path, r"(?:^|/)([^/]+/(?:pdfs|cache)/.*)$", 1)
    data = F.regexp_extract(path, r"(?:^|/)(data/.*)$", 1)
    kept = F.when(inner.startswith(F.concat(source, F.lit("/"))), F.concat(F.lit("data/"), inner)).when(data != "", data).otherwise(path)
    return F.regexp_replace(kept, r"^(?:data/)+", "data/")


def sanitize_filename(col: Column) -> Column:
    """Lower case with plain letters, `_` for spaces, and only `[a-z0-9_.-]`; `untitled` if nothing is left."""
    low = F.translate(F.lower(col), "áàâäãåçéèêëíìîïñóòôöõúùûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy")
    kept = F.regexp_replace(F.regexp_replace(F.translate(low, " ", "_"), r"[^a-z0-9_.-]", ""), r"_+", "_")
    kept = F.btrim(kept, F.lit("_.-"))
    return F.when(F.coalesce(kept, F.lit("")) == "", F.lit("untitled")).otherwise(kept)


def source_key(col: Column) -> Column:
    """A source field's column name: stripped, lower, `_` for spaces, only `[a-z0-9_]`, prefixed `src_`."""
    return F.concat(F.lit("src_"), F.regexp_replace(F.translate(F.lower(F.trim(col)), " ", "_"), r"[^a-z0-9_]", ""))


def split_multi(col: Column) -> Column:
    """Parts between semicolons, trimmed, without blanks."""
    return F.filter(F.transform(F.split(col, ";"), lambda x: F.trim(x)), lambda x: x != "")


def split_multivalue(col: Column) -> Column:
    """Parts between "; ", else between " | ", never between commas."""
    parts = F.when(col.contains("; "), F.split(col, "; ")).when(col.contains(" | "), F.split(col, r" \| ")).otherwise(F.array(col))
    return F.filter(F.transform(parts, lambda x: F.trim(x)), lambda x: x != "")


def looks_concatenated(col: Column) -> Column:
    """Two or more places where a capital follows a small letter at once."""
    return F.regexp_count(col, F.lit("[a-z][A-Z]")) >= 2


def extract_code(col: Column) -> Column:
    return F.trim(F.substring_index(col, " - ", 1))


def taxonomy_name(col: Column) -> Column:
    at = F.instr(col, " - ")
    return F.when(at > 0, F.trim(F.substring(col, at + 3, F.length(col)))).otherwise(F.trim(col))


def node_id_from_name(col: Column) -> Column:
    """Digits after the last underscore of a file's stem."""
    got = F.regexp_extract(col, r"_(\d+)(?:\.[^./_]*)?$", 1)
    return F.when(got != "", got)


def model_prefix(text: Column, model: Column, kind: str) -> Column:
    """`query: ` or `passage: ` for the models that ask for it."""
    return F.when(F.lower(model).contains("e5"), F.concat(F.lit(f"{kind}: "), text)).otherwise(text)


def parse_boost_fields(col: Column, default: float = 0.5) -> Column:
    """`a:0.5,b` -> map of weights; a missing or bad weight is the default."""
    parts = F.filter(F.transform(F.split(col, ","), lambda x: F.trim(x)), lambda x: x != "")
    pairs = F.transform(parts, lambda p: F.struct(F.trim(F.substring_index(p, ":", 1)).alias("key"), F.coalesce(F.when(p.contains(":"), F.trim(F.substring_index(p, ":", -1)).try_cast("double")), F.lit(default)).alias("value")))
    return F.map_from_entries(pairs)


def strip_markdown(col: Column) -> Column:
    """Without images, comments, code fences and heading marks; blank runs collapsed."""
    for pattern, by in ((r"!\[[^\]]*\]\([^)]*\)", ""), (r"<!--[\s\S]*?-->", ""), (r"```[a-zA-Z]*", ""), (r"(?m)^\*\*([^*\n]+)\*\*\s*$", "$1"), (r"[ \t]+", " "), (r"\n{3,}", "\n\n")):
        col = F.regexp_replace(col, pattern, by)
    return F.trim(col)


def excel_truncate(col: Column, limit: int = 32767) -> Column:
    return F.when(F.length(col) > limit, F.concat(F.substring(col, 1, limit - 3), F.lit("..."))).otherwise(col)


# fixed values: ISO 639-1 codes
LANGUAGES = {
    "af": "Afrikaans", "am": "Amharic", "ar": "Arabic", "az": "Azerbaijani", "be": "Belarusian", "bg": "Bulgarian", "bn": "Bengali", "bs": "Bosnian",
    "ca": "Catalan", "cs": "Czech", "cy": "Welsh", "da": "Danish", "de": "German", "el": "Greek", "en": "English", "es": "Spanish",
    "et": "Estonian", "eu": "Basque", "fa": "Persian", "fi": "Finnish", "fr": "French", "ga": "Irish", "gl": "Galician", "gu": "Gujarati",
    "ha": "Hausa", "he": "Hebrew", "hi": "Hindi", "hr": "Croatian", "hu": "Hungarian", "hy": "Armenian", "id": "Indonesian", "is": "Icelandic",
    "it": "Italian", "ja": "Japanese", "ka": "Georgian", "kk": "Kazakh", "km": "Khmer", "kn": "Kannada", "ko": "Korean", "ku": "Kurdish",
    "ky": "Kyrgyz", "la": "Latin", "lo": "Lao", "lt": "Lithuanian", "lv": "Latvian", "mk": "Macedonian", "ml": "Malayalam", "mn": "Mongolian",
    "mr": "Marathi", "ms": "Malay", "mt": "Maltese", "my": "Burmese", "ne": "Nepali", "nl": "Dutch", "no": "Norwegian", "pa": "Punjabi",
    "pl": "Polish", "ps": "Pashto", "pt": "Portuguese", "ro": "Romanian", "ru": "Russian", "rw": "Kinyarwanda", "si": "Sinhala", "sk": "Slovak",
    "sl": "Slovenian", "so": "Somali", "sq": "Albanian", "sr": "Serbian", "sv": "Swedish", "sw": "Swahili", "ta": "Tamil", "te": "Telugu",
    "tg": "Tajik", "th": "Thai", "tl": "Filipino", "tr": "Turkish", "uk": "Ukrainian", "ur": "Urdu", "uz": "Uzbek", "vi": "Vietnamese",
    "yo": "Yoruba", "zh": "Chinese", "zu": "Zulu",
}


def language_name(col: Column) -> Column:
    """The name of a code; anything unknown passes through."""
    names = F.create_map(*(F.lit(x) for pair in LANGUAGES.items() for x in pair))
    return F.coalesce(F.try_element_at(names, F.lower(col)), col)


def language_code(col: Column) -> Column:
    codes = F.create_map(*(F.lit(x) for k, v in LANGUAGES.items() for x in (v.lower(), k)))
    return F.coalesce(F.try_element_at(codes, F.lower(col)), col)


def roman_to_int(col: Column) -> Column:
    """The value of a roman numeral of at most six characters below 1000; null for any other text."""
    valid = F.lower(col).rlike("^(?=.{1,6}$)d?c{0,4}(xc|xl|l?x{0,3})(ix|iv|v?i{0,3})$") | F.lower(col).rlike("^c[d]?(xc|xl|l?x{0,3})(ix|iv|v?i{0,3})$")
    worth = lambda c: F.when(c == "i", 1).when(c == "v", 5).when(c == "x", 10).when(c == "l", 50).when(c == "c", 100).when(c == "d", 500).otherwise(0)
    values = F.transform(F.split(F.lower(col), ""), worth)
    total = F.aggregate(values, F.struct(F.lit(0).alias("sum"), F.lit(0).alias("last")), lambda s, v: F.struct((s["sum"] + v - F.when(s["last"] < v, s["last"] * 2).otherwise(0)).alias("sum"), v.alias("last")), lambda s: s["sum"])
    return F.when(valid, total)


# fixed values: what the bytes of an old Macintosh encoding become when read as Windows text
MOJIBAKE = {"ˆ": "à", "Ž": "é", "ž": "û", "Š": "ä", "š": "ö"}


def fix_mojibake(col: Column) -> Column:
    """Only where two or more marks stand; then an `Õ` between word characters is an apostrophe, too."""
    fixed = F.translate(col, "".join(MOJIBAKE), "".join(MOJIBAKE.values()))
    fixed = F.regexp_replace(fixed, r"(?<=[\p{L}\p{N}_])Õ(?=[\p{L}\p{N}_])", "’")
    return F.when(F.regexp_count(col, F.lit(f"[{''.join(MOJIBAKE)}]")) >= 2, fixed).otherwise(col)


def position_hint(top: Column, height: float = 842.0) -> Column:
    return F.round((F.lit(height) - top) / height, 3)


def year_of(col: Column) -> Column:
    return F.year(F.try_to_timestamp(col))


def year_to_unix(col: Column) -> Column:
    return F.unix_seconds(F.make_timestamp(col.try_cast("int"), F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0)))
