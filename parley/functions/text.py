"""Text rules for transcripts, as column expressions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Patterns of what speech models invent over silence, as the reference has them.
INVENTED = (
    r"hãy subscribe cho kênh", r"ghiền mì gõ", r"để không bỏ lỡ nh[uư]ng video hấp dẫn", r"đừng quên like và subscribe", r"nhấn nút đăng ký", r"cảm ơn các bạn đã theo dõi", r"hãy đăng ký kênh",
    r"xin chào các bạn.*kênh", r"hẹn gặp lại.*video", r"like.*share.*subscribe", r"thank you for watching", r"please subscribe", r"like and subscribe", r"don'?t forget to subscribe", r"hit the bell",
    r"©.*all rights reserved", r"subtitles? by", r"www\.\w+\.\w+", r"^meeting\.?$", r"^meeting discussion\.?$", r"^cuộc họp công việc\.?$", r"^\.+$", r"^,+$",
)
#: Texts of at most so many characters, trimmed, are inventions too.
SHORTEST = 3
#: What Python's strip() takes off, and its \n before the end: Java's defaults differ.
BLANK = " \t\n\r\v\f\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"

#: What SQL's trim takes off: the space characters of Unicode, no line breaks and no tabs.
SPACES = " \xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+"))


def sentence_count(text: Column) -> Column:
    """Pieces of a text cut at white space behind . ! ? , or a line break."""
    return F.size(F.split(text, r"(?<=[.!?,\n])\s+"))


def invented(text: Column) -> Column:
    """Is a transcript part an invention: does it match one of the patterns, or has it at most SHORTEST characters?"""
    plain = F.btrim(text, F.lit(BLANK))
    return F.coalesce((F.length(plain) <= SHORTEST) | plain.rlike("(?iUd)" + "|".join(INVENTED)), F.lit(True))


def clock(seconds: Column) -> Column:
    """m:ss of whole seconds; null, NaN, infinite and negative ones are 0:00."""
    good = F.when(seconds.isNotNull() & ~F.isnan(seconds) & (seconds >= 0) & (seconds < float("inf")), seconds).otherwise(0.0)
    s = F.floor(good).cast("bigint")
    return F.concat(F.floor(s / 60).cast("string"), F.lit(":"), F.lpad((s % 60).cast("string"), 2, "0"))


#: Settings whose values are secrets.
SECRETS = ("nvidia_api_key", "llm_api_key", "soniox_api_key")


def masked(key: Column, value: Column) -> Column:
    """Of a secret setting of 8 characters or more the first and last four; other values stay."""
    hidden = F.concat(F.left(value, F.lit(4)), F.lit("***"), F.right(value, F.lit(4)))
    return F.when(key.isin(*SECRETS) & (F.length(value) >= 8), hidden).otherwise(value)


@F.pandas_udf(StringType())
def nfc(text: pd.Series) -> pd.Series:
    """Unicode normal form C, which Spark has no function for."""
    return text.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFC", t))


def upload_name(name: Column) -> Column:
    """A file name in normal form C, reserved and control characters as _, without dots, spaces and tabs at its
    ends; of more than 200 characters the stem is cut. Never empty."""
    clean = F.btrim(F.regexp_replace(nfc(name), r'[<>:"/\\\\|?*\x00-\x1f]', "_"), F.lit(". \t"))
    suffix = F.left(F.regexp_extract(clean, r"(?s)^.*(\..*)$", 1), F.lit(20))
    stem = F.regexp_replace(clean, r"(?s)\.[^.]*$", "")
    short = F.when(F.length(clean) > 200, F.concat(F.left(stem, F.lit(200) - F.length(suffix)), suffix)).otherwise(clean)
    return F.coalesce(F.nullif(short, F.lit("")), F.lit("upload.bin"))


def attachment_name(name: Column) -> Column:
    """The last component of a path, in normal form C, without control characters, 200 at most. Never empty."""
    last = F.btrim(F.regexp_replace(F.regexp_replace(F.coalesce(name, F.lit("untitled")), "/+$", ""), "(?s)^.*/", ""))
    clean = F.regexp_replace(nfc(last), r"[\p{Cc}\p{Cf}\p{Cn}\p{Co}\p{Zl}\p{Zp}]|[\p{Zs}&&[^ ]]", "")
    return F.left(F.coalesce(F.nullif(clean, F.lit("")), F.lit("untitled")), F.lit(200))


def title_name(title: Column, fallback: Column) -> Column:
    """A title as the base of a file name."""
    clean = F.regexp_replace(F.coalesce(F.nullif(title, F.lit("")), fallback), r'[\\\\/:*?"<>|]+', "-")
    return F.coalesce(F.nullif(F.btrim(F.regexp_replace(clean, r"\s+", " ")), F.lit("")), fallback)


def suffix(name: Column) -> Column:
    """The lower-case suffix of a file name, with its dot; empty if there is none."""
    return F.lower(F.regexp_extract(name, r"(?s)[^/.][^/]*(\.[^./]+)$", 1))


def duration(seconds: Column) -> Column:
    s = F.floor(seconds).cast("bigint")
    return F.concat(F.floor(s / 60).cast("string"), F.lit("m "), (s % 60).cast("string"), F.lit("s"))


def seconds_string(ms: Column) -> Column:
    """Milliseconds as seconds with two decimals; null is 0."""
    return F.coalesce(F.format_string("%.2f", ms / 1000.0), F.lit("0"))


def sentence_case(text: Column) -> Column:
    """The first word of each sentence with a capital, all others in lower case; words of 2 to 5 capitals stay."""
    capitals = lambda w: (F.upper(w) == w) & (F.lower(w) != w) & F.length(w).between(2, 5)
    first = lambda w: F.concat(F.upper(F.left(w, F.lit(1))), F.lower(F.substring(w, F.lit(2), F.length(w))))
    word = lambda w, i: F.when(capitals(w), w).when(i == 0, first(w)).otherwise(F.lower(w))
    words = lambda s: F.filter(F.split(s, r"\s+"), lambda w: w != "")
    told = F.transform(F.split(text, r"(?<=[.!?])\s+"), lambda s: F.array_join(F.transform(words(s), word), " "))
    return F.array_join(F.filter(told, lambda s: s != ""), " ")


def truncated(text: Column, source: Column) -> Column:
    """A translation much longer than its source, cut behind the last sentence that ends in the second half of the
    length allowed (1.8 times the source's), or there."""
    most = F.floor(F.length(source) * F.lit(1.8)).cast("int")
    cut = F.left(text, most)
    ends = [F.length(cut) - F.locate(mark[::-1], F.reverse(cut)) - 1 for mark in (". ", ".\n", "! ", "? ")]
    found = [(F.locate(mark, cut) > 0) & (end > most * 0.5) for mark, end in zip((". ", ".\n", "! ", "? "), ends)]
    chosen = F.when(found[0], ends[0]).when(found[1], ends[1]).when(found[2], ends[2]).when(found[3], ends[3])
    return F.when((F.length(text) > most) & (most > 20), F.btrim(F.coalesce(F.left(cut, chosen + 1), cut), F.lit(BLANK))).otherwise(text)


def wordless(text: Column) -> Column:
    """Has a text nothing but punctuation and white space?"""
    return F.btrim(F.regexp_replace(text, r"(?U)[^\w\s]", "")) == ""


def minutes_title(summary: Column) -> Column:
    """The title that minutes state: their first heading of level one, else of level two, a title line, bold text
    at the beginning, or the first line that is no list item; without emoji before it, 160 characters at most."""
    lines = F.filter(F.transform(F.split(summary, "\n"), lambda x: F.btrim(x)), lambda x: x != "")
    first = lambda ok: F.get(F.filter(lines, ok), F.lit(0))
    emoji = r"^[\x{1F000}-\x{1FAFF}\x{2600}-\x{27BF}\x{2B00}-\x{2BFF}\x{2300}-\x{23FF}\x{FE0F}\s]+"
    plain = lambda line, head: F.nullif(F.left(F.btrim(F.regexp_replace(F.regexp_replace(line, head, ""), emoji, "")), F.lit(160)), F.lit(""))
    named = r"(?iu)^(tiêu đề|tieu de|title)\s*[:\-]\s*"
    bold = F.nullif(F.left(F.btrim(F.regexp_extract(F.get(lines, F.lit(0)), r"^\*\*(.+?)\*\*", 1)), F.lit(160)), F.lit(""))
    content = first(lambda x: ~x.rlike(r"^[-*]\s+") & ~x.rlike(r"^\d+\.\s+") & (F.length(x) > 3))
    return F.coalesce(plain(first(lambda x: x.rlike(r"^#\s+")), r"^#\s+"), plain(first(lambda x: x.rlike(r"^##\s+")), r"^##\s+"), plain(first(lambda x: x.rlike(named)), named), bold, plain(content, emoji))


#: Voices at or below and at or above these pitches (Hz), and what sets two voices apart.
MALE, FEMALE, APART, SOFT, SOFT_MOST = 145.0, 165.0, 25.0, 0.003, 0.06


def pitch_zone(f0: Column) -> Column:
    return F.when(f0.isNull(), "unknown").when(f0 <= MALE, "male").when(f0 >= FEMALE, "female").otherwise("neutral")


def cross_gender(a: Column, b: Column) -> Column:
    """Are two voices of different definite zones and far enough apart?"""
    x, y = pitch_zone(a), pitch_zone(b)
    return F.coalesce(x.isin("male", "female") & y.isin("male", "female") & (x != y) & (F.abs(a - b) >= APART), F.lit(False))


def soft_penalty(a: Column, b: Column) -> Column:
    """What the similarity of two voices loses when just one of them is of the neutral zone."""
    one = (pitch_zone(a) == "neutral") != (pitch_zone(b) == "neutral")
    return F.when(a.isNotNull() & b.isNotNull() & one, F.least(F.abs(a - b) * SOFT, F.lit(SOFT_MOST))).otherwise(0.0)


#: Frames that a pitch must rest on, differences that set apart voices of one zone, and how far voices of one tone may be.
FRAMES, FAR_FEMALE, FAR_MALE, TONE_MEDIAN, TONE_SPAN, TONE_DELTA, TONE_FACTOR, TONE_MOST = 6, 40.0, 90.0, 80.0, 120.0, 80.0, 0.03, 0.08


def far_in_zone(a: Column, frames_a: Column, b: Column, frames_b: Column) -> Column:
    """Are two voices of one definite zone far apart in pitch?"""
    zone = pitch_zone(a)
    least = F.when(zone == "female", FAR_FEMALE).when(zone == "male", FAR_MALE)
    return F.coalesce((frames_a >= FRAMES) & (frames_b >= FRAMES) & (zone == pitch_zone(b)) & (F.abs(a - b) >= least), F.lit(False))


def tone_penalty(median: Column, span: Column, delta: Column, frames: Column) -> Column:
    """What similarity loses by differences in median, span and change of pitch; frames: the fewer of both voices."""
    score = median / TONE_MEDIAN + span / TONE_SPAN + delta / TONE_DELTA
    return F.when(frames >= FRAMES, F.least(score * TONE_FACTOR, F.lit(TONE_MOST))).otherwise(0.0)


def hints(csv: Column) -> Column:
    """Language hints of a comma-separated list; Vietnamese where there are none."""
    found = F.filter(F.transform(F.split(csv, ","), lambda x: F.btrim(x)), lambda x: x != "")
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("vi")))


def stamp(text: Column, otherwise: Column) -> Column:
    """The time, UTC, of a text like 2026-01-31 23:59:59, or another one."""
    return F.coalesce(F.try_to_timestamp(text, F.lit("yyyy-MM-dd HH:mm:ss")), otherwise)


def number(text: Column) -> Column:
    """A finite number of a text, else 0."""
    found = text.try_cast("double")
    return F.when(found.isNotNull() & ~F.isnan(found) & (F.abs(found) < float("inf")), found).otherwise(0.0)


def local_time(at: Column, zone: str = "UTC", language: str = "en") -> Column:
    """A time (UTC) as a list of meetings shows it, in a time zone: 01/31/2026, 11:59 PM; in Vietnamese 23:59 31/01/2026."""
    there = F.from_utc_timestamp(at, zone)
    return F.date_format(there, "HH:mm dd/MM/yyyy") if language == "vi" else F.date_format(there, "MM/dd/yyyy, hh:mm a")


def text_items(json: Column) -> Column:
    """The texts of a JSON array that are not blank, trimmed; elements of other kinds are left out, and what is no array has none."""
    raw = F.coalesce(F.from_json(json, "array<variant>"), F.array().cast("array<variant>"))
    texts = F.transform(raw, lambda v: F.when(F.schema_of_variant(v) == "STRING", F.btrim(F.try_variant_get(v, "$", "string"), F.lit(BLANK))))
    return F.filter(texts, lambda t: F.coalesce(t != "", F.lit(False)))


def action_items(json: Column) -> Column:
    """task, assignee, deadline of the objects of a JSON array that have a task; numbers count as texts, other fields are left out."""
    raw = F.coalesce(F.from_json(json, "array<variant>"), F.array().cast("array<variant>"))
    part = lambda v, k: F.btrim(F.coalesce(F.try_variant_get(v, f"$.{k}", "string"), F.lit("")), F.lit(BLANK)).alias(k)
    rows = F.transform(raw, lambda v: F.struct(part(v, "task"), part(v, "assignee"), part(v, "deadline")))
    return F.filter(rows, lambda r: r["task"] != "")
