"""Scalars on the cases that their documentation gives, and on odd input."""

import datetime

import pytest
from pyspark.sql import functions as F

from pagewright.functions import classify as C
from pagewright.functions import metadata as M
from pagewright.functions import paragraphs as P
from pagewright.functions import text as X

CASES = [
    ("non_ascii", X.clean_non_ascii_chars, "\x88This text contains non-ascii characters!\x88", "This text contains non-ascii characters!"),
    ("bullets", X.clean_bullets, "●  This is an excellent point!", "This is an excellent point!"),
    ("bullets_none", X.clean_bullets, " ● x", " ● x"),
    ("bullets_double", X.clean_bullets, "●● x", "●● x"),
    ("ordered", X.clean_ordered_bullets, "1.1 This is a very important point", "This is a very important point"),
    ("ordered_dots", X.clean_ordered_bullets, "1..1 x", "1..1 x"),
    ("ordered_long", X.clean_ordered_bullets, "abc.1 x", "abc.1 x"),
    ("whitespace", X.clean_extra_whitespace, "ITEM 1.     BUSINESS  x\n", "ITEM 1. BUSINESS x"),
    ("dashes", X.clean_dashes, "ITEM 1. -BUSINESS–", "ITEM 1.  BUSINESS"),
    ("trailing", X.clean_trailing_punctuation, "ITEM 1.     BUSINESS.", "ITEM 1.     BUSINESS"),
    ("prefix", lambda t: X.clean_prefix(t, "summary:", ignore_case=True), "SUMMARY:  text", "text"),
    ("postfix", lambda t: X.clean_postfix(t, "END"), "text  END", "text"),
    ("quotes", X.replace_unicode_quotes, "\x93What a lovely quote!\x94", "“What a lovely quote!”"),
    ("quotes_mojibake", X.replace_unicode_quotes, "Itâ\x80\x99s", "It's"),
    ("punct", X.remove_punctuation, "“A lovely quote!”, he said。", "A lovely quote he said"),
    ("mime", X.replace_mime_encodings, "5 w=E2=80=99s", "5 w’s"),
    ("bytes", X.bytes_string_to_string, "\xe6\xaf\x8f", "每"),
    ("norm", X.norm_text, " a　b\n\nc ", "a b c"),
    ("before", lambda t: X.extract_text_before(t, "SUMMARY"), "abc SUMMARY d", "abc"),
    ("before_none", lambda t: X.extract_text_before(t, "z"), "abc", None),
    ("after_second", lambda t: X.extract_text_after(t, "S", 1), "S a S b", "b"),
    ("email", X.extract_email_address, "Me me@email.com and You <You@email.com>", ["me@email.com", "you@email.com"]),
    ("ip_two_digits", X.extract_ip_address, "from 192.168.10.12", []),
    ("ip6", X.extract_ip_address, "ba23::58b5:2236:45g2:88h2 10.0.2.01", ["ba23::58b5:2236:45g2:88h2", "10.0.2.01"]),
    ("mapi", X.extract_mapi_id, "with MAPI id 32.88.5467.123; x", ["32.88.5467.123"]),
    ("date", X.extract_datetimetz, "Fri, 26 Mar 2021 11:04:09 +1200", datetime.datetime(2021, 3, 25, 23, 4, 9)),
    ("phone", X.extract_us_phone_number, "Phone Number: 215-867-5309", "215-867-5309"),
    ("ordered_parts", X.extract_ordered_bullets, "a.1 This is a very important point", ("a", "1", None)),
    ("ordered_parts_1", X.extract_ordered_bullets, "1. point", ("1", None, None)),
    ("encoding", X.normalize_encoding, "ISO-8859-8-I", "iso_8859_8"),
    ("has_phone", X.contains_us_phone_number, "867-5309", True),
    ("zip", C.is_us_city_state_zip, "Doylestown, PA 18901", True),
    ("zip_name", C.is_us_city_state_zip, "Doylestown, Pennsylvania, 18901", True),
    ("zip_upper", C.is_us_city_state_zip, "DOYLESTOWN, PENNSYLVANIA 18901", True),
    ("zip_first_state", C.is_us_city_state_zip, "Mobile, AL 36601", True),
    ("mail_prefix", C.is_email_address, "a@b.co and more", True),
    ("mail_upper", C.is_email_address, "Bob@x.com", False),
    ("bulleted", C.is_bulleted_text, "-5 degrees", True),
    ("alpha", C.under_non_alpha_ratio, "-----------BREAK---------", True),
    ("alpha_blank", C.under_non_alpha_ratio, "   ", False),
    ("title_zh", lambda t: C.is_possible_title(t, language="zh"), "标题，不是", False),
    ("title_comma", C.is_possible_title, "To My Dearest Friends,", False),
    ("title_upper", C.is_possible_title, "ALERT!", False),
    ("title", C.is_possible_title, "Risk Factors", True),
    ("cap", C.exceeds_cap_ratio, "Risk Factors", True),
    ("numeric", C.is_possible_narrative_text, "12345", False),
    ("type", C.element_type, "The dog is running fast. It was happy with all of us today.", "NarrativeText"),
    ("emoji", C.contains_emoji, "hi 😀", True),
    ("image", C.embedded_image, "see [image: cat.png] here", "cat.png"),
    ("date_arg", C.is_valid_date_arg, "2020-01-31", True),
    ("date_arg_bad", C.is_valid_date_arg, "31/01/2020", False),
    ("new_lines", P.auto_paragraph_grouper, "a b\nc d", "a b\n\n\nc d"),
    ("broken", P.group_broken_paragraphs, "The big red fox\nis walking down the lane.\n\nAt the end of the lane\nthe fox met a bear.", "The big red fox is walking down the lane.\n\nAt the end of the lane the fox met a bear."),
    ("hyphen", P.group_broken_paragraphs, "well-known\nfoo bar", "well\n\n-\n\nknown\n\nfoo bar"),
    ("short_lines", P.group_broken_paragraphs, "Apache License\nVersion 2.0, January 2004", "Apache License\n\nVersion 2.0, January 2004"),
    ("bullets_par", P.group_broken_paragraphs, "○ The big red fox\nis walking down the lane.\n\n○ At the end of the lane\nthe fox met a friendly bear.", "○ The big red fox is walking down the lane.\n\n○ At the end of the lane the fox met a friendly bear."),
    ("pack", lambda t: P.split_by_paragraph(t, 0, 20), "aaa bbb. ccc ddd eee fff. ggg", ["aaa bbb.", "ccc ddd eee fff. ggg"]),
    ("halves", lambda t: P.split_by_paragraph(t, 0, 20), "hh ii jj kk ll mm nn oo", ["hh ii jj kk", "ll mm nn oo"]),
    ("combine", lambda t: P.split_by_paragraph(t, 10, 50), "a b\nc d\ne f g h i j k l m n o p\nzz", ["a b c d e f g h i j k l m n o p zz"]),
    ("window", lambda t: P.chunk_by_attention_window(t, 5, 2), "a b c d e f g", ["a b c", "d e f", "g"]),
    ("file", M.file_name, "/a/b/c.txt", "c.txt"),
    ("folder", M.file_directory, "/a/b/c.txt", "/a/b"),
    ("no_folder", M.file_directory, "c.txt", None),
    ("id", M.element_id, "x", "2d711642b726b04401627ca9fbac32f5"),
]


@pytest.mark.parametrize("name, f, given, want", CASES, ids=[c[0] for c in CASES])
def test_case(spark, name, f, given, want):
    df = spark.createDataFrame([(given,), (None,)], "t string")
    got = [r[0] for r in df.select(f(F.col("t"))).collect()]
    assert (tuple(got[0]) if isinstance(want, tuple) else got[0]) == want


def test_window_errors(spark):
    with pytest.raises(ValueError):
        P.chunk_by_attention_window(F.lit("x"), 2, 2)


def test_no_text_is_lost(spark, sf_dir):
    """Packing and chunking keep every word, in order."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("text", P.split_by_paragraph(F.col("text"), 0, 200).alias("p"), P.chunk_by_attention_window(F.col("text"), 50).alias("c"))
    for r in d.collect():
        assert " ".join(r.p).split() == r.text.split()
        assert " ".join(r.c) == r.text
        assert all(len(x) <= 200 for x in r.p)


def test_regex_metadata(spark):
    df = spark.createDataFrame([("a 12 b 12 c",), ("none",)], "t string")
    got = [r[0] for r in df.select(M.regex_metadata(df.t, {"n": "[0-9]+", "z": "zz"})).collect()]
    assert [(m.text, m.start, m.end) for m in got[0]["n"]] == [("12", 2, 4), ("12", 7, 9)] and list(got[0]) == ["n"] and got[1] == {}


def test_partition_text_bounds(spark, sf_dir):
    with pytest.raises(ValueError):
        P.partition_text(spark.read.parquet(f"{sf_dir}/documents.parquet"), min_partition=10, max_partition=5)


def test_lines(spark):
    df = spark.createDataFrame([("an exam-|ple of|text.|Next", 'a "b|c" d, e!')], "a string, b string")
    r = df.select(X.join_lines(F.split("a", r"\|")), X.join_lines(F.split("a", r"\|"), "zh"), X.join_lines(F.split("a", r"\|"), is_table=True), X.half_to_full_width(F.split("b", r"\|"))).first()
    assert list(r) == ["an example of text. Next", "an exam-ple oftext.Next", "an exam-\nple of\ntext.\nNext", ["a“b", "c”d，e！"]]
