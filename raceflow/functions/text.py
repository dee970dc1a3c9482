"""Cleaning rules for scraped text fields, as Column expressions.

Each rule returns NULL for text it cannot read; none of them raises under ANSI
mode. ``F.col`` style columns go in, columns come out.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Texts that stand for "no value".
MISSING = ["---", "---.-", ""]
MISSING_NAMES = ["---", "---.-", "編集"]
# Named margins and their seconds.
NAMED_MARGINS = {"同着": 0.0, "ハナ": 0.02, "アタマ": 0.04, "クビ": 0.05, "大差": 5.0, "大": 5.0}
SECONDS_PER_LENGTH = 0.2
# Where an id sits in a link.
ID_PATTERNS = {
    "horse": r"/horse/(\w+)",
    "jockey": r"/jockey/(?:result/recent/)?(\w+)",
    "trainer": r"/trainer/(?:result/recent/)?(\w+)",
    "race": r"/race/(\w+)",
}
# Full-width forms and their plain counterparts.
FULL_WIDTH = "".join(chr(c) for c in range(0xFF01, 0xFF5F)) + "　"
HALF_WIDTH = "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)) + " "


def _present(text: Column) -> Column:
    return text.isNotNull() & ~text.isin(MISSING) & (F.trim(text) != "")


def _group(text: Column, pattern: str, index: int = 1) -> Column:
    """Regex group, or NULL when the pattern does not match."""
    return F.when(text.rlike(pattern), F.regexp_extract(text, pattern, index))


def int_or_null(text: Column) -> Column:
    """All digits of the text as one number (sign and dot are dropped); 0 is NULL."""
    n = F.regexp_replace(text, "[^0-9]", "").try_cast("int")
    return F.when(_present(text) & (n > 0), n)


def float_or_null(text: Column) -> Column:
    """Digits and dots as a double; 0 and unreadable are NULL."""
    cleaned = F.regexp_replace(text, "[^0-9.]", "")
    x = F.when(cleaned.rlike(r"^([0-9]+\.?[0-9]*|\.[0-9]+)$"), cleaned.try_cast("double"))
    return F.when(_present(text) & (x > 0), x)


def sex_and_age(text: Column) -> tuple[Column, Column]:
    return F.when(text != "", F.substring(text, 1, 1)), int_or_null(F.substring(text, 2, 1_000))


def time_to_seconds(text: Column) -> Column:
    """``m:ss.d`` or ``s.d`` at the start of the text; the decimals count as tenths."""
    full, short = r"^(\d+):(\d+)\.(\d+)", r"^(\d+)\.(\d+)"

    def part(pattern, i):
        return _group(text, pattern, i).try_cast("long")

    return F.when(text.rlike(full), part(full, 1) * 60 + part(full, 2) + part(full, 3) / F.lit(10.0)
                  ).when(text.rlike(short), part(short, 1) + part(short, 2) / F.lit(10.0))


def margin_to_seconds(text: Column) -> Column:
    """Named margins, ``a.b/c``, ``b/c`` or plain lengths, at 0.2 s per length."""
    named = F.lit(None).cast("double")
    for name, seconds in NAMED_MARGINS.items():
        named = F.when(text == name, F.lit(seconds)).otherwise(named)
    mixed, fraction, plain = r"^(\d+)\.(\d+)/(\d+)$", r"^(\d+)/(\d+)$", r"^\d+(\.\d*)?$"

    def num(pattern, i):
        return _group(text, pattern, i).try_cast("double")

    lengths = (
        F.when(text.rlike(mixed), num(mixed, 1) + F.try_divide(num(mixed, 2), num(mixed, 3)))
        .when(text.rlike(fraction), F.try_divide(num(fraction, 1), num(fraction, 2)))
        .when(text.rlike(plain), text.try_cast("double"))
    )
    return F.coalesce(named, F.round(lengths * SECONDS_PER_LENGTH, 3))


def weight_and_change(text: Column) -> tuple[Column, Column]:
    """``478(+2)`` → 478, 2; ``478`` → 478, NULL."""
    return (_group(text, r"^(\d+)").try_cast("int"),
            F.regexp_replace(_group(text, r"^\d+\(([+-]?\d+)\)"), r"^\+", "").try_cast("int"))


def prize(text: Column) -> Column:
    """Thousands separators dropped, rounded half to even."""
    cleaned = F.trim(F.replace(text, F.lit(","), F.lit("")))
    return F.when(~text.contains("---"), F.bround(cleaned.try_cast("double"), 0).try_cast("long"))


def name(text: Column) -> Column:
    cleaned = F.trim(text)
    return F.when((cleaned != "") & ~cleaned.isin(MISSING_NAMES), cleaned)


def plain_odds(text: Column) -> Column:
    cleaned = F.trim(F.replace(text, F.lit(","), F.lit("")))
    return F.when(~cleaned.isin(MISSING), cleaned.try_cast("double"))


def id_from_link(href: Column, kind: str) -> Column:
    return _group(href, ID_PATTERNS[kind])


def race_id_from_file(file_name: Column) -> Column:
    """First run of 12 digits."""
    return _group(file_name, r"(\d{12})")


def horse_id_from_file(file_name: Column) -> Column:
    """``horse_``/``ped_`` plus 10 letters or digits, else 10 leading digits."""
    return F.coalesce(_group(file_name, "(?:horse|ped)_([a-zA-Z0-9]{10})"), _group(file_name, r"^(\d{10})"))


def ancestor_id(text: Column) -> Column:
    """Letters and digits only; NULL for all zeros or a length outside 4…10."""
    cleaned = F.regexp_replace(text, "[^a-zA-Z0-9]", "")
    return F.when(F.length(cleaned).between(4, 10) & ~cleaned.rlike("^0+$"), cleaned)


def iso_date(text: Column) -> Column:
    """``Y年M月D日``, ``Y/M/D`` or ``Y-M-D`` anywhere in the text; NULL if no such day."""
    pattern = r"(\d{4})[年/-](\d{1,2})[月/-](\d{1,2})"
    parts = [F.lpad(F.regexp_extract(text, pattern, i), width, "0") for i, width in ((1, 4), (2, 2), (3, 2))]
    return F.when(text.rlike(pattern), F.try_to_date(F.concat_ws("-", *parts), "yyyy-MM-dd"))


def day_in_year(text: Column, year: Column) -> Column:
    """``M月D日`` or ``M/D`` completed with a year known from elsewhere."""
    pattern = r"(\d{1,2})[月/](\d{1,2})"
    month, day = (F.lpad(F.regexp_extract(text, pattern, i), 2, "0") for i in (1, 2))
    return F.when(text.rlike(pattern),
                  F.try_to_date(F.concat_ws("-", year.cast("string"), month, day), "yyyy-MM-dd"))


def to_half_width(text: Column) -> Column:
    """Full-width ASCII forms and the ideographic space to their plain forms."""
    return F.translate(text, FULL_WIDTH, HALF_WIDTH)


def compatibility_form(text: Column) -> Column:
    """Full compatibility normalisation (NFKC): full-width and half-width forms, circled and squared signs,
    ligatures, letters with separate accents. Arrow batches go to the Unicode tables of the workers' Python,
    which Spark has no expression for; where the full-width forms are enough, ``to_half_width`` stays in the JVM."""
    @F.pandas_udf("string")
    def normalised(texts: pd.Series) -> pd.Series:
        return texts.str.normalize("NFKC")

    return normalised(text)


def distance_surface_condition(text: Column) -> tuple[Column, Column, Column]:
    """``ダ1800良`` → 1800, ダート, 良; digits alone give the distance only."""
    full = "^(芝|ダ)([0-9]+)(良|稍重|重|不良)?"
    matched = text.rlike(full)
    distance = F.when(matched, F.regexp_extract(text, full, 2)).otherwise(_group(text, "^([0-9]+)"))
    surface = F.when(text.rlike("^芝[0-9]"), "芝").when(text.rlike("^ダ[0-9]"), "ダート")
    condition = F.when(matched, F.regexp_extract(text, full, 3))
    return distance.try_cast("int"), surface, F.when(condition != "", condition)


def course(text: Column) -> tuple[Column, Column]:
    """Surface and metres from a course line such as ``芝右 外1800m``."""
    pattern = r"(芝|ダ|障)\s*(?:右|左|直|外|内)?\s*(?:右|左|直|外|内)?\s*(\d+)m"
    kind = _group(text, pattern, 1)
    surface = F.when(kind == "芝", "芝").when(kind == "ダ", "ダート").when(kind == "障", "障害")
    return surface, F.coalesce(_group(text, pattern, 2), _group(text, r"馬場\s*[：:]\s*(\d+)m")).try_cast("int")


def meeting(text: Column) -> tuple[Column, Column, Column]:
    """``1回中山2日目`` → 1, 中山, 2."""
    pattern = r"(\d+)回(\S+?)(\d+)日目"
    return (_group(text, pattern, 1).try_cast("int"), _group(text, pattern, 2),
            _group(text, pattern, 3).try_cast("int"))


# Texts in a race name and the class each stands for. Longer
# grades come first so that GIII is not read as GI.
RACE_CLASSES = [("GIII", "G3"), ("G3", "G3"), ("GII", "G2"), ("G2", "G2"), ("GI", "G1"), ("G1", "G1"),
                ("オープン", "OP"), ("OP", "OP"), ("1600万", "1600"), ("1000万", "1000"),
                ("500万", "500"), ("未勝利", "未勝利"), ("新馬", "新馬")]
AGE_LIMITS = ["2歳", "3歳以上", "4歳以上", "3歳"]


def race_class(race_name: Column) -> Column:
    out = F.lit(None).cast("string")
    for needle, label in reversed(RACE_CLASSES):
        out = F.when(race_name.contains(needle), label).otherwise(out)
    return out


def age_limit(race_name: Column) -> Column:
    out = F.lit(None).cast("string")
    for label in reversed(AGE_LIMITS):
        out = F.when(race_name.contains(label), label).otherwise(out)
    return out


def prize_list(text: Column, places: int = 5) -> list[Column]:
    """``本賞金:510,200万円`` → one integer per place, NULL where missing."""
    listed = F.split(_group(text, r"本賞金:([\d,]+)万円"), ",")
    return [F.get(listed, i).try_cast("int") for i in range(places)]


def corners(text: Column, count: int = 4) -> list[Column]:
    """``6-6-5-4`` (brackets ignored) → one integer per corner."""
    parts = F.split(F.regexp_replace(text, r"[()（）]", ""), "-")
    return [int_or_null(F.get(parts, i)) for i in range(count)]


def first_corner(text: Column) -> Column:
    """Leading position of a corner string; NULL unless it is a whole number."""
    return F.get(F.split(text, "-"), 0).try_cast("int")


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def short_hash(text: Column, size: int = 8) -> Column:
    return F.substring(F.sha2(text, 256), 1, size)


def race_number(race_id: Column) -> Column:
    return F.right(race_id, F.lit(2)).try_cast("int")


_STAMP = r"(\d{4}-\d{2}-\d{2}\s+\d{2}:\d{2}:\d{2},\d{3})"


def log_line(line: Column, with_module: bool = True) -> Column:
    """``stamp - [module -] LEVEL - message`` as a struct of logged_at, module, level
    and message; NULL when the line has another shape."""
    shape = rf"^{_STAMP}\s+-\s+" + (r"(\S+)\s+-\s+" if with_module else "()") + r"(\w+)\s+-\s+(.+)"
    part = [F.regexp_extract(line, shape, i) for i in range(5)]
    return F.when(line.rlike(shape), F.struct(
        F.try_to_timestamp(part[1], F.lit("yyyy-MM-dd HH:mm:ss,SSS")).alias("logged_at"),
        F.nullif(part[2], F.lit("")).alias("module"),
        part[3].alias("level"), F.trim(part[4]).alias("message")))
