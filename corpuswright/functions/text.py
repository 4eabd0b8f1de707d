"""Column functions on source text: hashes, versions, signals, identifiers, offsets, windows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import CLASSES

#: Strings (possibly unterminated), comments, and what is neither. Possessive
#: quantifiers make Java loop where it would recurse, so long literals are safe.
_TOKEN = r"""(?s)"(?:[^"\\]++|\\.)*+(?:"|\\?\z)|'(?:[^'\\]++|\\.)*+(?:'|\\?\z)|//[^\n]*+|/\*.*?(?:\*/|\z)|[^"'/]++|/"""
#: Fixed value: every character that Python's str.split() treats as white space.
WHITE = r"[\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
#: Signature patterns, case-insensitive.
SIGNALS = {
    "value_call": r"\.call\.value\s*\(|\.call\s*\{[^}]*value\s*:|\.call\.gas",
    "low_level": r"\.call\s*[\({]|\.send\s*\(",
    "access": r"\bselfdestruct\b|\bsuicide\b|tx\.origin|\.?delegatecall\s*\(",
    "loop": r"\bfor\s*\(|\bwhile\s*\(",
    "external": r"\.send\s*\(|\.transfer\s*\(|\.call\s*[\({]",
    "operator": r"\+\+|--|[+\-*]=|\bSafeMath\b|\w\s*[+\-*]\s*\w",
}


def normalise_newlines(s: Column) -> Column:
    return F.regexp_replace(s, "\r\n?", "\n")


def head(s: Column, n: int = 4096) -> Column:
    """The first n characters."""
    return F.substring(s, 1, n)


def strip_comments(s: Column) -> Column:
    """Source without comments: a line comment vanishes, a closed block comment is a space, an open one vanishes.

    Comment marks within string literals stay.
    """

    def kept(t: Column) -> Column:
        closed = t.endswith("*/") & (F.length(t) >= 4)
        return F.when(t.startswith("//"), "").when(t.startswith("/*"), F.when(closed, " ").otherwise("")).otherwise(t)

    return F.array_join(F.transform(F.regexp_extract_all(s, F.lit(_TOKEN), F.lit(0)), kept), "")


def content_hash(s: Column) -> Column:
    """SHA-256 of the source without comments, white space collapsed."""
    return F.sha2(F.trim(F.regexp_replace(strip_comments(s), WHITE, " ")), 256)


def pragma_spec(s: Column) -> Column:
    return F.nullif(F.regexp_extract(s, r"pragma\s+solidity\s+([^;]+);", 1), F.lit(""))


def pragma_minor(s: Column) -> Column:
    """major.minor of the first version in the first pragma, null without one."""
    return F.nullif(F.regexp_extract(pragma_spec(s), r"(\d+\.\d+)\.\d+", 1), F.lit(""))


def pragma_exact(s: Column) -> Column:
    """The version that a pragma pins exactly, else null."""
    return F.nullif(F.regexp_extract(F.trim(F.regexp_replace(pragma_spec(s), r"\s", " ")), r"^=?\s*(\d+\.\d+\.\d+)$", 1), F.lit(""))


def choose_compiler(s: Column, by_minor: Column, exact: Column) -> Column:
    """The compiler for a source, from maps of minor and of exact versions: a pin gets that version or null."""
    return F.when(pragma_exact(s).isNotNull(), F.try_element_at(exact, pragma_exact(s))).otherwise(F.try_element_at(by_minor, pragma_minor(s)))


def is_collectable(s: Column) -> Column:
    return pragma_minor(s).isNotNull()


def detect_signals(s: Column) -> Column:
    """The classes that a source's text suggests, in class order."""
    hit = lambda name: s.rlike("(?iU)" + SIGNALS[name])
    minor = F.split(pragma_minor(s), r"\.")
    major, second = F.get(minor, F.lit(0)).try_cast("int"), F.get(minor, F.lit(1)).try_cast("int")
    old = F.coalesce((major < 0) | ((major == 0) & (second < 8)), F.lit(False))
    tests = {"reentrancy": hit("value_call"), "access_control": hit("access"), "arithmetic": old & hit("operator"), "unchecked_calls": hit("low_level"), "dos": hit("loop") & hit("external")}
    return F.array_compact(F.array(*[F.when(tests[c], F.lit(c)) for c in CLASSES]))


def finding_identifiers(finding: Column) -> Column:
    """Candidate identifiers of a finding (struct with name, swc-id, swc_id): its name, its number, numbers in its name."""
    name = F.trim(F.coalesce(finding["name"], F.lit("")))
    swc = F.trim(F.coalesce(finding["swc-id"], finding["swc_id"], F.lit("")))
    number = F.when(swc == "", F.lit(None)).when(F.upper(swc).startswith("SWC-"), swc).otherwise(F.concat(F.lit("SWC-"), swc))
    inside = F.transform(F.regexp_extract_all(name, F.lit(r"(?i)SWC[\s\-_]*0*(\d{1,4})"), F.lit(1)), lambda x: F.concat(F.lit("SWC-"), x))
    return F.concat(F.array_compact(F.array(F.when(name != "", name), number)), inside)


def byte_offset_to_line(s: Column, offset: Column) -> Column:
    """1-based line of a byte offset into the UTF-8 text; offsets are held to the text."""
    before = F.substring(s.cast("binary"), F.lit(1), F.greatest(offset, F.lit(0)))
    # read as text again only to be counted byte by byte: a cut character does no harm
    return (F.octet_length(before) - F.octet_length(F.replace(before.cast("string"), F.lit("\n"), F.lit(""))) + 1).cast("int")


def span_lines(s: Column, start: Column, length: Column) -> Column:
    """The lines, in order, that a span of bytes touches; an empty span touches the one of its start."""
    last = byte_offset_to_line(s, start + F.greatest(length - 1, F.lit(0)))
    return F.sequence(byte_offset_to_line(s, start), last)


def parse_span(src: Column) -> Column:
    """(start, length, file) of 'start:length:file'; missing or odd parts are 0."""
    part = lambda i: F.coalesce(F.get(F.split(src, ":"), F.lit(i)).try_cast("int"), F.lit(0))
    return F.struct(part(0).alias("start"), part(1).alias("length"), part(2).alias("file"))


def expand(lines: Column, tolerance: int) -> Column:
    """Distinct lines within `tolerance` of the given ones."""
    return F.array_sort(F.array_distinct(F.flatten(F.transform(lines, lambda x: F.sequence(x - tolerance, x + tolerance)))))


def tokens(s: Column) -> Column:
    return F.filter(F.split(s, WHITE), lambda t: t != "")


def windows(toks: Column, size: int = 512, stride: int = 384, most: int = 8) -> Column:
    """Array of token windows, one at every multiple of stride below the length, at most `most`; one empty window for none."""
    starts = F.slice(F.sequence(F.lit(0), F.greatest(F.size(toks), F.lit(1)) - 1, F.lit(stride)), 1, most)
    return F.transform(starts, lambda i: F.slice(toks, i + 1, F.lit(size)))


def pad(window: Column, size: int, filler: str = "") -> Column:
    return F.concat(window, F.array_repeat(F.lit(filler), F.lit(size) - F.size(window)))


def mask(window: Column, size: int) -> Column:
    return F.concat(F.array_repeat(F.lit(1), F.size(window)), F.array_repeat(F.lit(0), F.lit(size) - F.size(window)))


def unique_in_order(xs: Column) -> Column:
    """Distinct entries in the order of their first places."""
    return F.array_distinct(xs)


def shown(x: Column) -> Column:
    """A number with three decimals, n/a for null."""
    return F.coalesce(F.format_string("%.3f", x.cast("double")), F.lit("n/a"))


def tex_escape(s: Column) -> Column:
    return F.replace(s, F.lit("_"), F.lit("\\_"))


def order_key(seed: int, ident: Column) -> Column:
    """The key that stands for a seeded shuffle: md5 of seed and id."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), ident.cast("string")))
