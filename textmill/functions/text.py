"""Column functions on text: blanks, noise, whitespace, encoding, slugs."""

from __future__ import annotations

import unicodedata

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textmill.functions.batches import udf

#: White space as Python's strip() sees it, spelled out because \s differs between regex engines.
BLANK = r"[\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"

#: The same characters one by one.
BLANKS = "".join(map(chr, (*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))

#: Lines that carry no content, matched from their start without regard to case.
NOISE_PATTERNS = (
    r"página\s+[0-9]+\s*$",
    r"[0-9]+\s*$",
    r"-\s*[0-9]+\s*-\s*$",
    r"\[\s*[0-9]+\s*\]$",
    r"BOJA\s+núm\.\s+[0-9]+",
    r"Boletín Oficial de la Junta de Andalucía",
    r"www\.juntadeandalucia\.es",
    r"https?://[^\s]+$",
    r"Depósito Legal:",
    r"ISSN:",
    r"[=_*-]{3,}$",
    r"\.{3,}$",
    r"[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}$",
    r"(?:Inicio|Menú|Buscar|Contacto|Imprimir|Compartir)\s*$",
    r"(?:Volver|Ir a|Ver más|Leer más)\s*$",
    r"Este sitio web utiliza cookies",
    r"Política de privacidad",
    r"Aviso legal",
    r"Content-Type:",
    r"Encoding:",
    r"\[Imagen:.*\]$",
    r"\[Link:.*\]$",
)
#: Words of running headers.
HEADER_KEYWORDS = ("consejería", "junta de andalucía", "boja", "boe", "boletín oficial", "depósito legal", "issn", "nipo")
#: Text that was read as Windows-1252 though it was UTF-8, and what it stood for.
MOJIBAKE = tuple(
    (c.encode("utf-8").decode("cp1252", "ignore"), c)
    for c in "áéíóúñüÁÉÍÓÚÑÜ°«»—–‘’“”•€"
    if len(c.encode("utf-8").decode("cp1252", "ignore")) == len(c.encode("utf-8"))
)


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body) -> Column:
    """body(value) with the value computed once: inside a lambda, an outer expression would be
    computed again for every element."""
    return F.transform(F.array(value), body)[0]


def strip(c: str | Column) -> Column:
    return F.btrim(col(c), F.lit(BLANKS))


def last_wins(pairs: Column) -> Column:
    """Map of an array of (key, value) structs; the last value of a key stays."""
    later = lambda all_pairs, p, i: F.exists(F.slice(all_pairs, i + 2, F.size(all_pairs) + 1), lambda q: q["key"] == p["key"])
    return let(pairs, lambda a: F.map_from_entries(F.filter(a, lambda p, i: ~later(a, p, i))))


def noise_regex(extra: tuple[str, ...] = ()) -> str:
    """One alternation for one pass; the flags are left to the caller's regex engine."""
    return "^(?:" + "|".join((*NOISE_PATTERNS, *extra)) + ")"


def bare_is_noise(bare: Column, extra: tuple[str, ...] = ()) -> Column:
    """is_noise for a line without blanks around it."""
    return (F.length(bare) < 3) | bare.rlike(f"^(?:{BLANK}|[-_.=*])+$") | bare.rlike("(?iu)" + noise_regex(extra))


def is_noise(line: str | Column, extra: tuple[str, ...] = ()) -> Column:
    return let(strip(line), lambda bare: bare_is_noise(bare, extra))


def squeeze(text: str | Column) -> Column:
    """Runs of spaces to one, three or more line ends to two, every line stripped."""
    one = F.regexp_replace(F.regexp_replace(col(text), " +", " "), "\n{3,}", "\n\n")
    return F.array_join(F.transform(F.split(one, "\n"), strip), "\n")


def _nfc(texts: list[str | None]) -> pa.Array:
    return pa.array([None if t is None else unicodedata.normalize("NFC", t) for t in texts], pa.string())


def nfc(text: str | Column) -> Column:
    """Unicode NFC; only texts with other than ASCII characters go to Python."""
    t = col(text)
    return F.coalesce(udf(_nfc)(F.when(F.octet_length(t) > F.length(t), t)), t)


def fix_mojibake(text: str | Column) -> Column:
    """Longest wrong form first, so no form swallows another. Texts without their first letters stay as they are."""
    t = col(text)
    out = t
    for wrong, right in sorted(MOJIBAKE, key=lambda p: -len(p[0])):
        out = F.replace(out, F.lit(wrong), F.lit(right))
    return F.when(t.rlike("[" + "".join(sorted({wrong[0] for wrong, _ in MOJIBAKE})) + "]"), out).otherwise(t)


#: Latin letters with marks and what remains of them in ASCII.
FOLD = tuple((c, a) for c in map(chr, range(0xC0, 0x250)) if (a := unicodedata.normalize("NFKD", c).encode("ascii", "ignore").decode()) and len(a) == 1)


def slug(title: str | Column, longest: int = 150) -> Column:
    """A file name of the title: ASCII, spaces and dashes as _, cut; `documento` if nothing is left."""
    out = F.regexp_replace(col(title), r'[<>:"/\\|?*]', "")
    out = F.translate(out, "".join(c for c, _ in FOLD), "".join(a for _, a in FOLD))
    out = F.regexp_replace(out, r"[^\x00-\x7F]", "")
    out = F.regexp_replace(out, r"[\x09-\x0D\x20-]+", "_")
    out = F.substring(F.translate(out, ".,", ""), 1, longest)
    out = F.regexp_replace(out, "^_+|_+$", "")
    return F.when(F.coalesce(out, F.lit("")) == "", "documento").otherwise(out)
