"""Identity rules as column expressions: IRIs, slugs, canonical text, hashes, numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..model import NAMESPACES

#: What Python's str.split() takes for white space, and str.splitlines() for line ends.
WHITE = r"[\x09-\x0d\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+"
LINE_ENDS = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"
#: Decimal literals that Python's float() reads, without the special names.
_FLOAT = r"^[+-]?(\d+(_\d+)*\.?(\d+(_\d+)*)?|\.\d+(_\d+)*)([eE][+-]?\d+(_\d+)*)?$"
_SPECIAL = r"^(?i)[+-]?(inf|infinity|nan)$"


def iri_segment(x: Column) -> Column:
    """Percent-encoding with no safe characters beyond letters, digits and ``_.-~``."""
    encoded = F.url_encode(x)
    for found, better in (("+", "%20"), ("*", "%2A"), ("%7E", "~")):
        encoded = F.replace(encoded, F.lit(found), F.lit(better))
    return encoded


def shape_iri(*names: Column) -> Column:
    """Each name encoded on its own, so that names with slashes can't collide."""
    return F.concat(F.lit(NAMESPACES["gen"]), F.concat_ws("/", *map(iri_segment, names)))


def slug(x: Column) -> Column:
    """A readable file name: lower case, hyphens, and eight digits of the original's hash."""
    base = F.btrim(F.regexp_replace(F.lower(x), "[^a-zA-Z0-9]+", "-"), F.lit("-"))
    digest = F.left(F.sha2(x, 256), F.lit(8))
    return F.when(base == "", digest).otherwise(F.concat(base, F.lit("-"), digest))


def canonical_text(x: Column) -> Column:
    """White space runs become one blank; none at the ends."""
    return F.btrim(F.regexp_replace(x, WHITE, " "))


def content_hash(canonical: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(canonical, 256))


def text_hash(x: Column) -> Column:
    return content_hash(canonical_text(x))


def bnode(*parts: Column | str) -> Column:
    """A blank node's name that is the same on every retry."""
    return F.concat(F.lit("_:"), F.sha2(F.concat_ws("|", *[F.lit(p) if isinstance(p, str) else p for p in parts]), 256))


def joined_hash(parts: Column) -> Column:
    """sha256 of an array's parts, joined by a bar in order."""
    return F.sha2(F.array_join(parts, "|"), 256)


def leaf_reference(family: Column, selector_json: Column) -> Column:
    """Identity of a leaf reference; the version is left out on purpose."""
    return F.sha2(F.concat_ws("|", family, selector_json), 256)


def process_identity(fact_key: Column, leaf: Column, drift_kind: Column, fingerprint: Column) -> Column:
    return F.sha2(F.concat_ws("|", fact_key, leaf, drift_kind, fingerprint), 256)


def python_float(x: Column) -> Column:
    """What Python's float() gives; NULL where it would raise."""
    plain = F.btrim(F.regexp_replace(x, f"^{WHITE}|{WHITE}$", ""))
    number = F.regexp_replace(plain, "_", "").try_cast("double")
    named = F.regexp_replace(F.lower(plain), r"^([+-]?)inf$", "$1infinity")
    special = F.when(named.endswith("nan"), F.lit(float("nan"))).when(named.startswith("-"), F.lit(float("-inf"))).otherwise(F.lit(float("inf")))
    return F.when(plain.rlike(_FLOAT), number).when(plain.rlike(_SPECIAL), special)


def split_lines(x: Column) -> Column:
    """The lines as str.splitlines() gives them."""
    parts = F.split(x, LINE_ENDS, -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def expand_curie(x: Column, prefixes: Column) -> Column:
    """IRI of a prefixed name by a map of prefixes; NULL without a colon or for an unknown prefix."""
    at = F.instr(x, ":")
    base = F.try_element_at(prefixes, F.substring_index(x, ":", 1))
    return F.when((at > 0) & base.isNotNull(), F.concat(base, F.substr(x, at + 1)))


def local_name(iri: Column) -> Column:
    """The last path segment of an IRI."""
    return F.substring_index(iri, "/", -1)


def display_name(name: Column, iri: Column) -> Column:
    return F.coalesce(name, local_name(iri))


def shared_tokens_missing(source: Column, other: Column) -> Column:
    """Codes and numbers of ``source`` that ``other`` lacks, sorted."""
    pattern = F.lit(r"\b[A-Z]{2,}[0-9]*\b|\b\d+[a-zA-Z]?\b")
    return F.array_sort(F.array_except(F.regexp_extract_all(source, pattern, F.lit(0)), F.regexp_extract_all(other, pattern, F.lit(0))))
