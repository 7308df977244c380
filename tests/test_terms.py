import hashlib
from urllib.parse import quote

from pyspark.sql import functions as F

from spanloom.functions import terms


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_iri_segments_do_not_collide(spark):
    hard = "MiKa-FM 23/§ß~*()! +"
    assert one(spark, terms.iri_segment(F.lit(hard))) == quote(hard, safe="")
    a = one(spark, terms.shape_iri(F.lit("A"), F.lit("B/C"), F.lit("D")))
    b = one(spark, terms.shape_iri(F.lit("A"), F.lit("B"), F.lit("C/D")))
    assert a != b


def test_slugs_of_close_names_differ(spark):
    a, b, c = (one(spark, terms.slug(F.lit(x))) for x in ("Ab_FM", "Ab-FM", "§§"))
    assert a != b and a.startswith("ab-fm-") and c == hashlib.sha256("§§".encode()).hexdigest()[:8]


def test_canonical_text_is_that_of_split(spark):
    text = "  a b\x1cc　\n\td\x85e​f "
    assert one(spark, terms.canonical_text(F.lit(text))) == " ".join(text.split())
    assert one(spark, terms.text_hash(F.lit(text))) == "sha256:" + hashlib.sha256(" ".join(text.split()).encode()).hexdigest()


def test_lines_are_those_of_splitlines(spark):
    for text in ("a\nb", "a\r\nb\rc\x0bd\x0ce\x1cf\x85g h i\n", "a|b\n\nc", "x"):
        assert one(spark, terms.split_lines(F.lit(text))) == text.splitlines()


def test_floats_are_those_of_python(spark):
    for text in ("1_0", " 0.95 ", "1d", "0x1", "1e3", ".5", "5.", "_1", "1__0", "", "inf", "-Infinity", "abc", "+.5e-2"):
        try:
            wanted = float(text)
        except ValueError:
            wanted = None
        assert one(spark, terms.python_float(F.lit(text))) == wanted, text
    assert one(spark, F.isnan(terms.python_float(F.lit("NaN"))))


def test_curies(spark):
    prefixes = F.create_map(F.lit("a"), F.lit("urn:a#"))
    assert one(spark, terms.expand_curie(F.lit("a:b:c"), prefixes)) == "urn:a#b:c"
    assert one(spark, terms.expand_curie(F.lit("b:c"), prefixes)) is None
    assert one(spark, terms.expand_curie(F.lit("plain"), prefixes)) is None


def test_display_name_falls_back(spark):
    assert one(spark, terms.display_name(F.lit(None).cast("string"), F.lit("urn:x/y/z"))) == "z"


def test_missing_tokens(spark):
    assert one(spark, terms.shared_tokens_missing(F.lit("see AB12 and 7a, XY"), F.lit("XY only"))) == ["7a", "AB12"]
