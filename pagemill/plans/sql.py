"""Pieces of ANSI SQL for the checks."""

from __future__ import annotations

from pagemill.functions.text import ACCENTED_VOWELS, SCRIPTS, SYMBOL_PARTS, SYMBOL_STARTS

_SPACE = r"[\s\x{000B}\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"


def collapse(c: str) -> str:
    return f"regexp_replace(regexp_replace({c}, '{_SPACE}', ' ', 'g'), '^ | $', '', 'g')"


def norm(c: str) -> str:
    return f"regexp_replace(lower({collapse(c)}), '[0-9]+', '#', 'g')"


def letters(c: str) -> str:
    return f"length(regexp_replace({c}, '[^A-Za-z{ACCENTED_VOWELS}]', '', 'g'))"


def vowels(c: str) -> str:
    return f"length(regexp_replace({c}, '[^AEIOUaeiou{ACCENTED_VOWELS}]', '', 'g'))"


def matches(c: str, pattern: str) -> str:
    return f"len(regexp_extract_all({c}, '{pattern}'))"


RTL = r"[\x{0590}-\x{08FF}\x{FB1D}-\x{FDFF}\x{FE70}-\x{FEFC}]"
PRIVATE = r"[\x{E000}-\x{F8FF}]"
CONTROL = r"[\x{0000}-\x{0008}\x{000B}\x{000C}\x{000E}-\x{001F}\x{007F}-\x{009F}]"


def visible(c: str) -> str:
    # Java's \s has the vertical tab, which lies in the control range of both patterns
    return f"length(regexp_replace({c}, '[\\s\\x{{0000}}-\\x{{001F}}\\x{{007F}}-\\x{{009F}}]', '', 'g'))"


def chrome(c: str) -> str:
    s = f"lower({collapse(c)})"
    year, span = r"(^|[^0-9])(19|20)[0-9]{2}([^0-9-]|$)", r"(^|[^0-9-])[0-9]{1,4}[-–][0-9]{1,4}([^0-9-]|$)"
    parts = [r"https?://|www\.|doi\.org|©|^copyright |^\(c\) ", r"^page [0-9]+( of [0-9]+)?$", r"^[0-9]{1,4}$", r"(^|[^a-z])vol\.? ?[0-9]+"]
    tests = " OR ".join(f"regexp_matches({s}, '{p}')" for p in parts)
    return f"({tests} OR (strlen({s}) <= 120 AND regexp_matches({s}, '{year}') AND regexp_matches({s}, '{span}')))"


def between(c: str, inside: str, sign: str) -> str:
    """How often a sign stands between two characters of a class, which neighbours may share: each is doubled first."""
    return matches(f"regexp_replace({c}, '([{inside}])', '\\1\\1', 'g')", f"[{inside}]{sign}[{inside}]")


def judged(c: str) -> str:
    split = f"string_split_regex(regexp_replace({c}, '\\p{{Cc}}', ' ', 'g'), '{_SPACE}')"
    bare = f"list_transform(list_filter({split}, lambda t: t <> '' AND NOT regexp_matches(t, '[$\\\\]')), lambda t: regexp_replace(t, '^[^\\p{{L}}\\p{{N}}]+|[^\\p{{L}}\\p{{N}}]+$', '', 'g'))"
    return f"list_filter({bare}, lambda t: length(t) >= 3 AND regexp_matches(t, '\\p{{L}}.*\\p{{L}}'))"


def malformed(tokens: str) -> str:
    flips = f"NOT regexp_matches(t, '[_./@]') AND ({between('t', chr(92) + 'p{Ll}', chr(92) + 'p{Lu}')} >= 2 OR regexp_matches(t, '\\p{{Ll}}\\p{{Lu}}\\p{{Ll}}{{1,2}}([^\\p{{Ll}}]|$)'))"
    count = " + ".join(f"CAST(regexp_matches(t, '[{own}]') AS INT)" for own in SCRIPTS.values())
    other, accented = "".join(SCRIPTS.values()), "\\x{00C0}-\\x{00D6}\\x{00D8}-\\x{00F6}\\x{00F8}-\\x{024F}"
    mixed = f"({count} >= 2 OR regexp_matches(t, '[{accented}][{other}]|[{other}][{accented}]'))"
    return f"len(list_filter({tokens}, lambda t: {flips} OR regexp_matches(t, '\\p{{L}}[;=]\\p{{L}}') OR {mixed}))"


def symbol_font(c: str) -> str:
    return f"coalesce(regexp_matches(lower(regexp_replace({c}, '^[^+]*\\+', '')), '{SYMBOL_PARTS}|^({SYMBOL_STARTS})'), false)"


#: Distinct items with double geometry.
ITEMS = """it AS (SELECT DISTINCT doc_id, page, seq, text, CAST(x AS DOUBLE) x, CAST(y AS DOUBLE) y, CAST(width AS DOUBLE) width,
  CAST(height AS DOUBLE) height, CAST(rotation AS DOUBLE) rotation, font_name, CAST(font_size AS DOUBLE) font_size, font_weight, font_flags,
  has_unicode_map_error, CAST(confidence AS DOUBLE) confidence, link, strike, underline, mcid, math FROM text_items)"""
#: Lines of the documents.
LINES = """ln AS (SELECT doc_id, CAST(i AS INTEGER) line_no, l[i] AS line FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) i
  FROM (SELECT doc_id, string_split(text, chr(10)) l FROM documents WHERE text IS NOT NULL)))"""
