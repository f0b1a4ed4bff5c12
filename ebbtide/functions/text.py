"""Column functions over text: parsing, hashing, rule flags, masking."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Complaint wording, one pattern per entry; \b is a word edge, \s any white space.
COMPLAINT_PATTERNS = (
    r"\bkomplain\b",
    r"\bkeluhan\b",
    r"\bkecewa\b",
    r"\bburuk\b",
    r"\bparah\b",
    r"\btidak\s+(puas|sesuai|bagus|baik)\b",
    r"\bnggak\s+(puas|sesuai|bagus|baik)\b",
    r"\bgak\s+(puas|sesuai|bagus|baik)\b",
    r"\bkurang\s+(puas|bagus|baik|bersih|ramah)\b",
    r"\brusak\b",
    r"\bcacat\b",
    r"\bjelek\b",
    r"\btelat\b",
    r"\bterlambat\b",
    r"\blambat\b",
    r"\blama\s+banget\b",
    r"\bkasar\b",
)
# Refund and cancellation wording.
REFUND_PATTERNS = (
    r"\brefund\b",
    r"\buang\s+kembali\b",
    r"\bkembali(?:kan)?\s+uang\b",
    r"\bbalikin\s+uang\b",
    r"\bdana\s+kembali\b",
    r"\bcancel\s+booking\b",
    r"\bbatal(?:kan)?\s+booking\b",
)
# Filler replies that carry no topic.
FILLER_REPLIES = ("ok", "oke", "iya", "ya", "baik", "sip", "thanks", "makasih")

SPACE_CLASS = r"[\s\p{Z}\x0B\x1C-\x1F\x85]"


def phrase_regex(patterns: tuple[str, ...]) -> str:
    r"""One alternation matching any pattern as whole words.

    Word edges and white space mean those of every script: each pattern stands between characters that
    are neither letter, digit nor underscore, and a blank or ``\s`` in it is any white space.
    """
    body = "|".join(p.replace(r"\b", "").replace(r"\s", SPACE_CLASS).replace(" ", SPACE_CLASS + "+") for p in patterns)
    return r"(?<![\p{L}\p{N}_])(?:" + body + r")(?![\p{L}\p{N}_])"


_TIME = r"(?:[T\s]+(\d{1,2}):(\d{1,2})(?::(\d{1,2}(?:\.\d{1,6})?)\d*)?\s*(?:Z|UTC|[+-]\d{2}:?\d{2})?)?$"
_YEAR_FIRST = r"(\d{4})[-/](\d{1,2})[-/](\d{1,2})"
_YEAR_LAST = r"(\d{1,2})[-/](\d{1,2})[-/](\d{4})"
_DOTTED = r"(\d{1,2})\.(\d{1,2})\.(\d{4})"
_DAY_NAME = r"(\d{1,2})[\s-]+([a-z]{3,9})[\s,-]+(\d{4})"
_NAME_DAY = r"([a-z]{3,9})\.?\s+(\d{1,2})(?:st|nd|rd|th)?,?\s+(\d{4})"
#: All layouts in one pattern: groups 0-2, 3-5 and 6-8 are the numeric ones, 9-11 their time, 12-14 and 15-17 those with a name, 18-20 their time.
_LAYOUTS = f"^(?:(?:{_YEAR_FIRST}|{_YEAR_LAST}|{_DOTTED}){_TIME}|(?i:(?:{_DAY_NAME}|{_NAME_DAY}){_TIME}))"
_GROUPS = 21
_MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
_MONTH_NAMES = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")


def parse_datetime(value: Column) -> Column:
    """A3: a date, with or without time, as a zone-free timestamp, else NULL.

    Taken in turn: year first; day, month, year; month, day, year; and as a last resort dotted dates, month
    first where both readings exist, and texts with the month's English name. Times may have seconds, fractions (to microseconds) and a T before them; a zone
    mark is left out, the wall time counts. The parts go into the timestamp directly, so no
    session zone can move them. A cell is matched once: one pattern has all layouts, and its groups are split apart.
    """
    text = F.trim(value)
    cut = "\u0001"
    matched = F.regexp_replace(text, _LAYOUTS, cut.join(f"${g}" for g in range(1, _GROUPS + 1)))
    parts = F.split(F.nullif(matched, text), cut, -1)  # what does not match is unchanged

    def read(p: Column) -> Column:
        def number(group: int) -> Column:
            return p[group].try_cast("int")

        def made(first: int, time: int, year: Column, month: Column, day: Column) -> Column:
            seconds = F.coalesce(p[time + 2].try_cast("decimal(16,6)"), F.lit(0).cast("decimal(16,6)"))
            clock = [F.coalesce(number(time + g), F.lit(0)) for g in (0, 1)]
            return F.when((p[first] != "") & (seconds < 60), F.try_make_timestamp_ntz(year, month, day, *clock, seconds))

        def named(group: int) -> Column:
            name = F.lower(p[group])
            whole = F.lit([*_MONTHS, *_MONTH_NAMES, "sept"])
            return F.when(F.array_contains(whole, name), F.array_position(F.lit(list(_MONTHS)), F.substring(name, 1, 3)).cast("int"))

        return F.when(p[0] != "", made(0, 9, number(0), number(1), number(2))).otherwise(
            F.when(p[3] != "", F.coalesce(made(3, 9, number(5), number(4), number(3)), made(3, 9, number(5), number(3), number(4)))).otherwise(
                F.when(p[6] != "", F.coalesce(made(6, 9, number(8), number(6), number(7)), made(6, 9, number(8), number(7), number(6)))).otherwise(
                    F.coalesce(made(12, 18, number(14), named(13), number(12)), made(15, 18, number(17), named(15), number(16)))
                )
            )
        )

    # the groups are bound once and read by all layouts
    return F.when(parts.isNotNull(), F.transform(F.array(parts), read)[0])


def normalize_phone(phone: Column) -> Column:
    """Digits only, a leading 0 replaced by the country code 62; NULL stays NULL."""
    return F.regexp_replace(F.regexp_replace(phone, r"[^0-9]", ""), "^0", "62")


def hash_phone(phone: Column, salt: str = "") -> Column:
    """SHA-256 of salt and normalised number; NULL when no digit is left."""
    digits = normalize_phone(phone)
    return F.when(F.length(digits) > 0, F.sha2(F.concat(F.lit(salt), digits), 256))


def hash_identifier(value: Column, salt: str = "") -> Column:
    return F.sha2(F.concat(F.lit(salt), value), 256)


def char_count(text: Column, char: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(char), F.lit("")))


def message_stats(text: Column) -> dict[str, Column]:
    """Code points, exclamation marks and question marks of a message."""
    text = F.coalesce(text, F.lit(""))
    return {
        "msg_length": F.length(text),
        "num_exclamations": char_count(text, "!"),
        "num_questions": char_count(text, "?"),
    }


def detect_refund(text: Column, patterns: tuple[str, ...] = REFUND_PATTERNS) -> Column:
    """Refund or cancellation wording anywhere in the text."""
    return F.coalesce(F.lower(text).rlike(phrase_regex(patterns)), F.lit(False))


def detect_complaint(
    text: Column,
    patterns: tuple[str, ...] = COMPLAINT_PATTERNS,
    refund_patterns: tuple[str, ...] = REFUND_PATTERNS,
) -> Column:
    """Complaint wording; a refund request counts as one."""
    return F.coalesce(F.lower(text).rlike(phrase_regex(patterns + refund_patterns)), F.lit(False))


def strip_space(text: Column) -> Column:
    """Trim every kind of white space, not only blanks."""
    return F.regexp_replace(text, f"^{SPACE_CLASS}+|{SPACE_CLASS}+$", "")


def normalize_text(text: Column) -> Column:
    """Runs of white space become one blank, ends trimmed."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), SPACE_CLASS + "+", " "))


def is_trainable(text: Column, min_chars: int = 15, fillers: tuple[str, ...] = FILLER_REPLIES) -> Column:
    """Long enough and not a mere filler reply."""
    clean = normalize_text(text)
    return (F.length(clean) >= min_chars) & ~F.lower(clean).isin(*fillers)


def words(text: Column) -> Column:
    """Lower-case white-space separated tokens of the whole text."""
    return F.filter(F.split(F.lower(text), SPACE_CLASS + "+"), lambda w: w != "")


def truncate(text: Column, limit: int) -> Column:
    """Cut to ``limit`` code points and mark the cut."""
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit("..."))).otherwise(text)


def mask_phone(phone: Column) -> Column:
    """First and last four characters; short numbers unchanged."""
    return (
        F.when(F.coalesce(F.length(phone), F.lit(0)) == 0, F.lit("-"))
        .when(F.length(phone) < 8, phone)
        .otherwise(F.concat(F.substring(phone, 1, 4), F.lit("****"), F.substring(phone, -4, 4)))
    )


def mask_phone_prefix(phone_hash: Column, keep: int = 8) -> Column:
    """Leading characters of a stored hash, rest hidden."""
    return F.concat(F.substring(phone_hash, 1, keep), F.lit("***"))


def coerce_numeric(value: Column) -> Column:
    """Text such as ``[5E-1]`` to double; anything unusable becomes 0."""
    bare = F.regexp_replace(F.trim(value.cast("string")), r"^[\[\]]+|[\[\]]+$", "")
    number = bare.try_cast("double")
    return F.coalesce(F.nanvl(number, F.lit(0.0)), F.lit(0.0))


def any_contains(text: Column, needles: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, [text.contains(n) for n in needles])
