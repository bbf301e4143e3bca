"""Texts of ASCII characters are tidied without Unicode classes: the same lines as with them."""

from itertools import product

from pyspark.sql import functions as F

from hirelens.functions import text

ALPHABET = [" ", "\t", "\n", "\r", "\x1c", "\x1f", "a", text.FIELD_MARK]


def test_ascii_and_unicode_tidying_agree_on_all_short_texts(spark):
    texts = ["".join(letters) for n in range(6) for letters in product(ALPHABET, repeat=n)]
    texts += [chr(c) * k + "b" + chr(c) + "c" + text.ITEM_MARK + chr(c) for c in range(128) for k in (0, 1, 3)]
    frame = spark.createDataFrame([(t,) for t in texts], "t string").repartition(8)
    joined = F.regexp_replace(F.regexp_replace("t", text.BLANK_RUN, " "), text.LINE_BREAKS, "\n")
    unicode = F.when(F.rlike("t", F.lit(text.UNTIDY)), F.regexp_replace(joined, text.EDGE, "")).otherwise(F.col("t"))
    assert frame.filter(~text.tidy_lines("t").eqNullSafe(unicode)).count() == 0
    plain = F.regexp_replace(F.regexp_replace("t", text.BLANK_RUN, " "), text.ASCII_LINE_BREAKS, "\n")
    assert frame.filter(~F.regexp_replace(plain, text.ASCII_EDGE, "").eqNullSafe(F.regexp_replace(joined, text.EDGE, ""))).count() == 0


def test_unicode_blanks_are_still_trimmed(spark):
    frame = spark.createDataFrame([("\u00a0a\u2003\u2028 b\u0085",), ("\u00e9 ",), (None,)], "t string")
    assert [r[0] for r in frame.select(text.tidy_lines("t")).collect()] == ["a\nb", "\u00e9", None]
