import re
import unicodedata
from urllib.parse import urljoin

from pyspark.sql import functions as F

from duelens.functions import dates, flags, numbers, text


def values(spark, expression, column, rows):
    frame = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], f"i int, {column}")
    return [r.v for r in frame.select("i", expression.alias("v")).orderBy("i").collect()]


def plain_slug(value):
    ascii_text = unicodedata.normalize("NFKD", value).encode("ascii", "ignore").decode("ascii")
    kept = re.sub(r"[^\w\s-]", "", ascii_text).strip().lower()
    return re.sub(r"[-\s]+", "-", kept)


NAMES = [
    "Lilly S.A",
    "Johnson & Johnson",
    "Pierre Fabre Médicament; Represented by",
    "Klinikum der Dümmy",
    "ﬁrst ½ №5 ＡＢＣ ㎏ 𝐁𝐨𝐥𝐝 한국 中文",
    "  --Edge--  case__x ",
    "",
    "áb c\td\x1ce",
    "ß œ ø İ",
    "Medicines Development (Infectious Diseases)",
]


def test_web_slug_equals_character_by_character_rule(spark):
    assert values(spark, text.web_slug(F.col("v")), "v string", NAMES) == [
        plain_slug(n) for n in NAMES
    ]


def test_every_foldable_character(spark):
    single_from, _, longer = text._ascii_folds()
    chars = [*single_from[::7], *list(longer)[::7]]
    got = values(spark, text.fold_to_ascii(F.col("v")), "v string", [f"a{c}b" for c in chars])
    assert got == [
        "a" + unicodedata.normalize("NFKD", c).encode("ascii", "ignore").decode() + "b"
        for c in chars
    ]


def test_identifier_slug(spark):
    rows = ["E.1.1 Medical condition(s)", "__Näme - of", "x" * 80, "EudraCT Number:"]
    assert values(spark, text.identifier_slug(F.col("v")), "v string", rows) == [
        "e_1_1_medical_condition_s",
        "näme_of",
        "x" * 63,
        "eudract_number",
    ]


def test_absolute_url_like_the_standard_library(spark):
    base = "https://host.example/a/b/c?x=1#top"
    hrefs = ["/d", "d/e", "../d", "./d", "../../../d", "?y=2", "#f", "//other/z", "http://q/w",
             "", "d/../e/./f", "..", "../", ".", "/a/../b?u=../v", "mailto:a@b"]
    got = values(spark, text.absolute_url(F.lit(base), F.col("v")), "v string", hrefs)
    assert got == [urljoin(base, h) for h in hrefs]
    assert values(
        spark, text.absolute_url(F.lit("http://host"), F.col("v")), "v string", ["x", "/y"]
    ) == ["http://host/x", "http://host/y"]


def test_titles(spark):
    frame = spark.createDataFrame(
        [(0, None, "Short"), (1, None, None), (2, "x" * 201, "s"), (3, "y" * 200, "s")],
        "i int, full string, short string",
    )
    shown = text.display_title(F.col("full"), F.col("short")).alias("v")
    assert [r.v for r in frame.select("i", shown).orderBy("i").collect()] == [
        "Short",
        "No Title",
        "x" * 200 + "...",
        "y" * 200,
    ]
    assert values(spark, text.without_line_breaks(F.col("v")), "v string", ["a\r\nb\n"]) == ["ab"]
    assert values(spark, text.null_if_nan_text(F.col("v")), "v string", ["nan", "x"]) == [None, "x"]


def test_dates(spark):
    day = F.to_date("v")
    assert [
        str(v)
        for v in values(
            spark, dates.due_date_cutoff(day), "v string", ["2018-01-17", "2000-02-29"]
        )
    ] == ["2016-12-20", "1999-01-31"]
    assert [str(v) for v in values(spark, dates.from_day_number(F.col("v")), "v int",
                                   [20807, 20688])] == ["2016-12-19", "2016-08-22"]
    found = values(spark, dates.parse_date(F.col("v"), ("yyyy-M-d", "d/M/yyyy")), "v string",
                   ["2015-10-05", "5/10/2015", None])
    assert [str(v) for v in found] == ["2015-10-05", "2015-10-05", "None"]


def test_rounding_and_percentages(spark):
    assert values(spark, numbers.half_even(F.col("v")), "v double", [12.25, 12.35, 71.42857]) == [
        12.2,
        12.4,
        71.4,
    ]
    share = numbers.percent(F.col("v"), F.lit(0))
    assert values(spark, share, "v long", [3, 0]) == [None, None]
    assert values(spark, numbers.percent_text(F.col("v")), "v double",
                  [50.0, None, float("nan")]) == ["50.0%", "-", "-"]
    assert values(spark, numbers.default_if_invalid(F.col("v"), "-"), "v double",
                  [1.5, None, float("nan")]) == ["1.5", "-", "-"]


def test_codes(spark):
    assert values(spark, flags.recode_count(F.col("v")), "v int", [1, 2, 3, 99, 100, None]) == [
        1, 2, 3, 3, 100, None]
    assert values(spark, flags.exact_or_pattern_flag(F.col("v"), "No", "Unclear"), "v string",
                  ["No", "x Unclear y", "fine", None]) == [1, 2, 0, 0]
    assert values(spark, flags.parse_boolean(F.col("v")), "v string", ["YES", "no", None]) == [
        True, False, None]
