"""Text functions: edge cases by hand, then random text against plain Python."""

from __future__ import annotations

import random
import re
from urllib.parse import parse_qs, urlparse

import pytest
from pyspark.sql import functions as F

from voxtally.functions import text as T
from voxtally.functions.urls import extract_video_id, is_video_url
from voxtally.operators.comments import preprocess


def values(spark, rows, expr, kind="string"):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], f"i int, c {kind}")
    return [r.v for r in df.select("i", expr.alias("v")).orderBy("i").collect()]


PIECES = (
    [chr(c) for c in range(0x1000, 0x10A0)]
    + list("abz019_ \t\n\r\x0b\x1c\x1f\x85 　 @#.,!?\\()-:/😀é")
    + [" http", "http://a/", "www.", "@ab", "#မြန်", " @", "# ", "https", "​"]
)


def random_texts(n=1500):
    rng = random.Random(7)
    return ["".join(rng.choices(PIECES, k=rng.randint(0, 25))) for _ in range(n)]


def python_clean(s):
    s = re.sub(r"http\S+", "", s)
    s = re.sub(r"@\w+", "", s)
    s = re.sub(r"#\w+", "", s)
    s = re.sub(r"[^က-႟\s.,!\\?()]", "", s)
    return re.sub(r"\s+", " ", s).strip()


def test_clean_text_is_what_python_computes(spark):
    texts = random_texts()
    assert values(spark, texts, T.clean_text("c")) == [python_clean(s) for s in texts]


def test_light_clean_is_what_python_computes(spark):
    texts = [*random_texts(), None, "", "  \t"]

    def python(s):
        s = re.sub(r"http\S+|www\S+", "", s or "")
        return re.sub(r"\s+", " ", re.sub(r"@\w+", "", s)).strip()

    assert values(spark, texts, T.light_clean("c")) == [python(s) for s in texts]


def test_tokens_and_strip_are_what_python_computes(spark):
    texts = random_texts()
    assert values(spark, texts, T.tokenize("c")) == [s.split() for s in texts]
    assert values(spark, texts, T.strip("c")) == [s.strip() for s in texts]


def test_script_ratio_is_what_python_computes(spark):
    texts = random_texts()
    inside = [sum("က" <= ch <= "႟" for ch in s) for s in texts]
    expected = [n / len(s) if s else None for n, s in zip(inside, texts)]
    assert values(spark, texts, T.script_ratio("c")) == expected


def test_script_filter_is_strict(spark):
    texts = ["မမမabcdefg", "မမမမabcdef", "", None, "😀"]
    assert values(spark, texts, T.is_script("c")) == [False, True, False, False, False]


def test_tag_ends_before_a_combining_mark(spark):
    assert values(spark, ["#မြန်မာ"], T.clean_text("c")) == [python_clean("#မြန်မာ")] == ["ြန်မာ"]


def test_syllables(spark):
    texts = ["မြန်မာစာ", "abc မြန်မာ12", "plain"]
    expected = ["မြန် မာ စာ", "abc မြန် မာ 12", "plain"]
    assert values(spark, texts, T.segment_script_runs("c")) == expected


def test_legacy_encoding(spark):
    texts = ["ဥဦ", "ဉ", "ဥဉ", "", None]
    assert values(spark, texts, T.is_legacy_encoded("c")) == [True, False, False, False, False]


def test_rewrite_rules_run_in_order(spark):
    assert values(spark, ["a", None], T.apply_rewrite_rules("c", [("a", "b"), ("b", "c")])) == ["c", None]


def test_preprocess_records_why_rows_are_rejected(spark):
    rows = ["မြန်မာစာ hello", "မမမမ", "မမမမမ", "hello", "", "   ", "😀😀", None]
    df = spark.createDataFrame(list(enumerate(rows)), "i int, text_display string")
    got = {r.i: r for r in preprocess(df).collect()}
    assert [got[i].reject_reason for i in range(len(rows))] == [
        None,
        "TOO_SHORT",
        None,
        *["NOT_SCRIPT"] * 4,
        "NULL_TEXT",
    ]
    assert got[0].text_unicode == "မြန်မာစာ" and got[0].token_count == 1
    assert got[1].text_unicode is None and got[1].tokens is None and got[1].token_count is None


def python_video_id(url):
    """The intended reading of an address, with '' meaning no id."""
    try:
        p = urlparse(url)
    except ValueError:
        return None
    found = None
    if "youtu.be" in p.netloc:
        found = p.path.lstrip("/")
    elif "youtube.com" in p.netloc:
        if "shorts" in p.path:
            found = p.path.split("/")[-1]
        else:
            found = parse_qs(p.query).get("v", [None])[0]
    return found or None


URLS = [
    "https://www.youtube.com/watch?v=a&t=1",
    "https://youtu.be/x?si=1",
    "https://youtu.be//x/y#z",
    "https://youtube.com/shorts/Q",
    "https://youtube.com/shorts/Q/",
    "https://youtube.com/shorts/Q?feature=share",
    "youtube.com/watch?v=a",
    "//youtube.com/watch?v=a",
    "https://youtube.com/watch?v=&v=b",
    "https://youtube.com/watch?vv=1&v=b",
    "https://youtube.com/watch?v=a%20b+c",
    "https://youtube.com/watch?v=100%&x=1",
    "https://m.youtube.com:443/watch?list=l&v=id#v=no",
    "https://youtube.com/watch#?v=no",
    "https://youtube.com.youtu.be/x",
    "https://example.com/youtube.com/watch?v=a",
    "  https://youtu.be/x",
    "not a url",
    "",
]


def test_video_id(spark):
    assert values(spark, [*URLS, None], extract_video_id("c")) == [
        *[python_video_id(u) for u in URLS],
        None,
    ]


def test_video_id_of_random_addresses(spark):
    rng = random.Random(3)
    pieces = "http s :// // youtu.be youtube.com / ? & v= shorts a # ; = %41 :80 watch".split()
    starts = ["https://"] * 2 + ["https://youtube.com/", "https://youtu.be/"]
    urls = [
        rng.choice(starts) + "".join(rng.choices(pieces, k=rng.randint(1, 9))) for _ in range(4000)
    ]
    got = values(spark, urls, extract_video_id("c"))
    wrong = [(u, g, python_video_id(u)) for u, g in zip(urls, got) if g != python_video_id(u)]
    assert wrong == [], wrong[:5]


def test_is_video_url(spark):
    texts = ["see youtu.be/x", "https://youtube.com/shorts/1", "youtube.com/watch?v=", "youtube.com", None]
    assert values(spark, texts, is_video_url("c")) == [True, True, True, False, None]


@pytest.mark.parametrize("n, expected", [(4, [True, True]), (5, [False, True])])
def test_min_length(spark, n, expected):
    assert values(spark, ["abcd", "abcde"], T.has_min_length("c", n)) == expected


def test_blank(spark):
    assert values(spark, ["a", " nan ", "", "　", None], F.coalesce(T.is_blank("c"))) == [
        False,
        True,
        True,
        True,
        True,
    ]
