"""Scalar functions on text, paths and hashes, as column expressions."""

from __future__ import annotations

import string
import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the namespace of point ids.
POINT_NAMESPACE = "6f7f2c3a1b6e4b8a9c2d5e1f0a9b8c7d"
#: A number with thousands spaces and decimals, not inside a word; cited pages; a line of a table of contents.
NUMBER = r"(?<![\w/])(\d{1,3}(?:[   ]\d{3})+|\d+)(?:[.,](\d+))?(?![\w/])"
CITED_PAGES = r"(?i)\b(?:pages?|p\.)\s*(\d{1,4})(?:\s*(?:-|–|à)\s*(\d{1,4}))?"
TOC_LINE = r"(?i)^\s*(?:(?:carte|figure|tableau|photo|planche|annexe|illustration)\s*n?°?\s*\d+\b|\d+(?:\.\d+){1,3}\s+\S).*?(?:\.{3,}\s*\d{1,3}|\bp(?:age)?\.?\s*\d{1,3}\)?|\s\d{1,3})\s*$"


def strip(x: Column) -> Column:
    return F.regexp_replace(x, r"^\s+|\s+$", "")


@lru_cache(maxsize=1)
def _plain_letters() -> tuple[str, str]:
    """Letters of the common alphabets that are one letter with marks, and that letter: by rule, from their decompositions."""
    pairs = [("\u2019", "'"), ("\u2018", "'")]
    for c in map(chr, [*range(0xA0, 0x600), *range(0x1E00, 0x2000), *range(0x3040, 0x3100)]):
        plain = [x for x in unicodedata.normalize("NFD", c) if unicodedata.category(x) != "Mn"]
        if len(plain) == 1 and plain[0] != c:
            pairs.append((c, plain[0]))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def deaccent(x: Column) -> Column:
    """Letters without their marks, composed or not; curly apostrophes as straight ones."""
    return F.regexp_replace(F.translate(x, *_plain_letters()), r"\p{Mn}+", "")


def plain(x: str) -> str:
    """:func:`deaccent` of a string."""
    if x.isascii():
        return x
    return "".join(c for c in x.translate(_plain_table()) if unicodedata.category(c) != "Mn")


@lru_cache(maxsize=1)
def _plain_table() -> dict[int, str]:
    return str.maketrans(*_plain_letters())


def file_context(name: Column, path: Column, kind: Column, title: Column | None = None, author: Column | None = None, subject: Column | None = None) -> Column:
    """``[Fichier: … | Chemin: last three parents | Type: …]``, missing parts left out."""
    parents = F.filter(F.split(path, "/"), lambda x: x != "")
    parents = F.slice(parents, 1, F.greatest(F.size(parents) - 1, F.lit(0)))
    last = F.array_join(F.slice(parents, F.greatest(F.size(parents) - 2, F.lit(1)), 3), "/")
    labelled = lambda label, x: F.concat(F.lit(f"{label}: "), F.nullif(x, F.lit("")))
    extra = [labelled(n, x) for n, x in (("Titre", title), ("Auteur", author), ("Sujet", subject)) if x is not None]
    parts = F.concat_ws(" | ", F.concat(F.lit("Fichier: "), name), labelled("Chemin", last), F.concat(F.lit("Type: "), F.upper(F.coalesce(kind, F.lit("document")))), *extra)
    return F.concat(F.lit("["), parts, F.lit("]"))


def point_id(chunk_id: Column) -> Column:
    """Name-based UUID (version 5) of a chunk id."""
    h = F.sha1(F.concat(F.unhex(F.lit(POINT_NAMESPACE)), F.encode(chunk_id, "UTF-8")))
    part = lambda a, n: F.substring(h, a, n)
    variant = F.lower(F.hex(F.conv(part(17, 1), 16, 10).cast("int").bitwiseAND(3).bitwiseOR(8)))
    return F.concat(part(1, 8), F.lit("-"), part(9, 4), F.lit("-5"), part(14, 3), F.lit("-"), variant, part(18, 3), F.lit("-"), part(21, 12))


def quick_hash(path: Column, size: Column, mtime: Column) -> Column:
    return F.substring(F.md5(F.concat_ws("|", path, size, mtime)), 1, 16)


def index_name(x: Column, default: str | None = "documents", lower: bool = False) -> Column:
    """Letters, digits, ``_`` and ``-``; spaces become ``_``; 64 characters; ``idx_`` before a digit or dash."""
    x = F.lower(x) if lower else x
    y = F.substring(F.regexp_replace(F.replace(strip(x), F.lit(" "), F.lit("_")), "[^A-Za-z0-9_-]", ""), 1, 64)
    y = F.when(y.rlike("^[0-9-]"), F.concat(F.lit("idx_"), y)).otherwise(y)
    return F.when(y == "", F.lit(default)).otherwise(y)


def sql_name(x: Column) -> Column:
    y = F.regexp_replace(F.regexp_replace(x, "[^A-Za-z0-9_]", "_"), "_+", "_")
    return F.substring(F.lower(F.regexp_replace(y, "^_+|_+$", "")), 1, 63)


def numbers(text: Column) -> Column:
    """Distinct numbers in one spelling: no thousands spaces, decimal point, no closing zeros."""
    found = F.regexp_extract_all(text, F.lit(NUMBER), F.lit(0))
    whole = lambda x: F.regexp_replace(F.regexp_extract(x, r"^[\d   ]+", 0), r"[   ]", "")
    tail = lambda x: F.regexp_replace(F.regexp_extract(x, r"[.,](\d+)$", 1), "0+$", "")
    return F.array_distinct(F.transform(found, lambda x: F.when(tail(x) == "", whole(x)).otherwise(F.concat(whole(x), F.lit("."), tail(x)))))


def numbers_as_written(text: Column) -> Column:
    """Distinct numbers as they stand in the text, each with its spelling of :func:`numbers`: ``written, whole, said``."""
    found = F.array_distinct(F.regexp_extract_all(text, F.lit(NUMBER), F.lit(0)))
    whole = lambda x: F.regexp_replace(F.regexp_extract(x, r"^[\d   ]+", 0), r"[   ]", "")
    tail = lambda x: F.regexp_replace(F.regexp_extract(x, r"[.,](\d+)$", 1), "0+$", "")
    return F.transform(found, lambda x: F.struct(x.alias("written"), whole(x).alias("whole"), F.when(tail(x) == "", whole(x)).otherwise(F.concat(whole(x), F.lit("."), tail(x))).alias("said")))


def cited_pages(text: Column) -> Column:
    """Cited pages; a range of at most 20 pages counts whole, a wider one by its first page."""
    first = F.regexp_extract_all(text, F.lit(CITED_PAGES), F.lit(1))
    last = F.regexp_extract_all(text, F.lit(CITED_PAGES), F.lit(2))
    both = F.arrays_zip(first.alias("a"), last.alias("b"))

    def pages(x: Column) -> Column:
        a = x["a"].cast("int")
        b = F.when(x["b"] == "", a).otherwise(F.nullif(x["b"], F.lit("")).cast("int"))
        return F.when((b < a) | (b - a > 20), F.array(a)).otherwise(F.sequence(a, F.greatest(a, b)))

    return F.array_sort(F.array_distinct(F.flatten(F.transform(both, pages))))


def is_contents_page(text: Column) -> Column:
    """At least five lines of a table of contents that are 40 % or more of the lines with text."""
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"\S"))
    toc = F.size(F.filter(lines, lambda x: x.rlike(TOC_LINE)))
    return F.coalesce((toc >= 5) & (toc >= 0.4 * F.size(lines)), F.lit(False))


def overlap_tail(text: Column, n: int) -> Column:
    """The last ``n`` characters, moved on to the start of a word; empty if there is none or the text is not longer."""
    tail = F.substring(text, -n, n)
    before = F.substring(text, -n - 1, 1)
    moved = F.when(tail.rlike(r"\s"), F.regexp_replace(tail, r"(?s)^\S*\s", "")).otherwise(F.lit(""))
    return F.when(F.length(text) <= n, F.lit("")).when(before.rlike(r"\s"), tail).otherwise(moved)


def needs_ocr(chars: Column, words: Column) -> Column:
    return (chars < 50) | (words < 8)


def kept_yield(reference: Column, extracted: Column, ratio: float) -> Column:
    """The reference text where it has 200 characters or more and the extracted one less than ``ratio`` of them."""
    return F.when((F.length(reference) >= 200) & (F.length(extracted) < ratio * F.length(reference)), reference).otherwise(extracted)


# names, questions, records

#: A capitalised word with its linked parts; what may stand between a line's start and its first word.
PROPER = r"[A-ZÀ-ÖØ-Þ][a-zß-öø-ÿ]+(?:[-'’][A-Za-zÀ-ÖØ-öø-ÿ]+)*"
_LINE_HEAD = r"(?:[-*•]|\d++[.)]|#{1,6}+)?"
#: Kinds of objects, how questions begin, themes in names of volumes, kinds of sections.
OBJECT_KINDS = ("comparaison", "etude", "mesure", "element", "forme")
QUESTION_HEADS = (
    r"^(quel|quelle|quels|quelles|qu['e])\b",
    r"^(comment|pourquoi|combien|où|quand)\b",
    r"^(est-ce que|y a-t-il|peut-on|faut-il)\b",
    r"^(what|how|why|where|when|which|who|is there|can)\b",
)
VOLUME_THEMES = r"\b(rnt|paysag|naturel|acoust|sant|milieu humain|physique)"


def proper_nouns(text: Column, lot: Column) -> Column:
    """Distinct capitalised words of four letters or more inside sentences that the lot holds as they are, but not in small letters."""
    return named_in(capitalised(text), lot)


def capitalised(text: Column) -> Column:
    """Distinct capitalised words of four letters or more inside sentences.

    Every such word is marked, and judged by what stands between it and the marked word before
    it: nothing at the head of a line or sentence reaches further back, since words have letters.
    """
    marked = F.regexp_replace(F.translate(text, "\ue000\ue001", "  "), rf"(?U)(?<![\w'’-])({PROPER})", "\ue000$1\ue001")
    pieces = F.split(marked, "\ue000")

    def judged(piece: Column, at: Column) -> Column:
        before = F.regexp_replace(F.element_at(F.split(F.get(pieces, at), "\ue001"), -1), r"[*_ \t]+\z", "")
        first = (at == 0) & before.rlike(rf"(?U)\A\s*+{_LINE_HEAD}+\s*+\z")
        head = first | before.rlike(r"[\n.!?;]\z") | before.rlike(rf"(?U)\n\s*+{_LINE_HEAD}+\s*+\z")
        return F.when(~head, F.get(F.split(piece, "\ue001"), F.lit(0)))

    words = F.array_distinct(F.array_compact(F.transform(F.slice(pieces, F.lit(2), F.greatest(F.size(pieces) - 1, F.lit(0))), judged)))
    return F.filter(words, lambda w: F.length(w) >= 4)


def named_in(words: Column, lot: Column) -> Column:
    """Those of capitalised words that the lot holds as they are, but not in small letters. A pattern is only tried where the letters occur."""
    small = lambda w: F.concat(F.lit(r"(?U)(?<![\w'’-])"), F.lower(w), F.lit(r"(?![\w-])"))
    return F.filter(words, lambda w: (F.instr(lot, w) > 0) & F.when(F.instr(lot, F.lower(w)) > 0, ~F.regexp_like(lot, small(w))).otherwise(True))


def object_kind(x: Column) -> Column:
    """One of ``OBJECT_KINDS`` that the value begins with, accents apart, else ''."""
    said = F.translate(F.lower(F.regexp_replace(strip(x), '^"+|"+$', "")), "éèê", "eee")
    out = F.when(said.isNull(), F.lit(""))
    for kind in OBJECT_KINDS:
        out = out.when(said.startswith(kind), F.lit(kind))
    return out.otherwise(F.lit(""))


def direct_question(x: Column) -> Column:
    """One sentence that ends with a question mark."""
    said = strip(F.coalesce(x, F.lit("")))
    return said.endswith("?") & ~F.regexp_replace(said, r"\?$", "").rlike(r"[.!?]\s+[A-ZÀ-Ý]")


#: A word's edge where only ASCII letters, digits and the low line make words, as RE2 and the engines built on it have it.
ASCII_EDGE = r"(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"


def is_question(x: Column, ascii_words: bool = False) -> Column:
    """Ends with a question mark or begins like a question. ``ascii_words``: a letter with an accent ends a word, as in SQL engines on RE2 ("queéé" begins with "que" there)."""
    said = F.lower(strip(F.coalesce(x, F.lit(""))))
    out = said.endswith("?")
    for head in QUESTION_HEADS:
        out = out | said.rlike(head.replace(r"\b", ASCII_EDGE) if ascii_words else head)
    return out


def filled(template: str, **fields: Column) -> Column:
    """A template with ``{field}`` marks as one column. Unknown fields, positional ones and stray braces raise, so a wrong template is never used."""
    parts: list[Column] = []
    for said, field, form, _ in string.Formatter().parse(template):
        parts += [F.lit(said)] if said else []
        if field is not None:
            if form or field not in fields:
                raise ValueError(f"no such field in the template: {field!r}; there are {sorted(fields)}")
            parts.append(F.coalesce(fields[field].cast("string"), F.lit("")))
    return F.concat(*parts) if parts else F.lit("")


def finite(x: Column) -> Column:
    """Null in place of NaN and infinities."""
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def cosine(a: Column, b: Column) -> Column:
    """The cosine of two arrays of doubles; 0 where one has no length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    return F.coalesce(F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))), F.lit(0.0))


def model_input(model: Column, text: Column, is_query: Column) -> Column:
    """The text as an encoder wants it: models of the E5 family get ``query:`` or ``passage:`` before it."""
    return F.when(F.lower(model).contains("e5"), F.concat(F.when(is_query, F.lit("query: ")).otherwise(F.lit("passage: ")), text)).otherwise(text)


def batch_size(longest: Column, batch: int = 32, budget: int = 32_000) -> Column:
    """How many texts of ``longest`` characters a batch takes within a budget of characters."""
    return F.when(longest <= 0, F.lit(batch)).otherwise(F.greatest(F.lit(1), F.least(F.lit(batch), F.floor(F.try_divide(F.lit(budget), longest)))).cast("int"))


def volume_keys(x: Column) -> Column:
    """Numbers of volumes and themes that a name or a source speaks of, sorted."""
    said = F.lower(deaccent(x))
    volumes = F.transform(F.regexp_extract_all(said, F.lit(r"tome[_ ]?(\d+)"), F.lit(1)), lambda n: F.concat(F.lit("tome"), n))
    return F.array_sort(F.array_distinct(F.concat(volumes, F.regexp_extract_all(said, F.lit(VOLUME_THEMES), F.lit(1)))))


def right_volume(expected: Column, names: Column) -> Column:
    """Does a passage's name share a key with the expected sources? Always, where they have none."""
    keys = F.flatten(F.transform(expected, volume_keys))
    return (F.size(keys) == 0) | F.coalesce(F.arrays_overlap(keys, F.flatten(F.transform(names, volume_keys))), F.lit(False))


def joined_or(items: Column, between: str = ", ", default: str = "aucun") -> Column:
    return F.coalesce(F.nullif(F.array_join(items, between), F.lit("")), F.lit(default))


def source_mentions(x: Column) -> Column:
    """``Tome n p. m`` for each mention of pages of a volume, in either order, then volumes that have none; each once."""
    after = r"(?i)(?:pages?|p\.)\s*(\d+)(?:\s*(?:à|a|-|et)\s*(\d+))?[^.;]{0,50}?du Tome\s*(\d)"
    before = r"(?i)Tome\s*(\d)[^.;]{0,90}?(?:page|p\.)\s*(\d+)"
    group = lambda pattern, k: F.regexp_extract_all(x, F.lit(pattern), F.lit(k))
    first = F.transform(F.arrays_zip(group(after, 3).alias("t"), group(after, 1).alias("a"), group(after, 2).alias("b")), lambda m: F.concat(F.lit("Tome "), m["t"], F.lit(" p. "), m["a"], F.when(m["b"] == "", "").otherwise(F.concat(F.lit("-"), m["b"]))))
    second = F.transform(F.arrays_zip(group(before, 1).alias("t"), group(before, 2).alias("p")), lambda m: F.concat(F.lit("Tome "), m["t"], F.lit(" p. "), m["p"]))
    paged = F.array_distinct(F.concat(first, second))
    bare = F.transform(F.array_distinct(F.regexp_extract_all(x, F.lit(r"Tome\s*(\d)"), F.lit(1))), lambda t: F.concat(F.lit("Tome "), t))
    return F.concat(paged, F.filter(bare, lambda t: ~F.exists(paged, lambda p: p.startswith(t))))


def distinct_strings(items: Column) -> Column:
    """Items in their order, each by its first spelling; case doesn't tell them apart."""
    low = F.transform(items, lambda x: F.lower(x))
    return F.filter(items, lambda x, i: F.array_position(low, F.lower(x)) == i + 1)


def path_prefixes(path: Column) -> Column:
    """A path and the paths above it, shortest first."""
    parts = F.split(path, "/")
    ends = F.filter(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/") != "")
    return F.transform(ends, lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))
