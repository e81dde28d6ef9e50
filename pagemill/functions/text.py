"""Column expressions over text: normalisation, patterns, counts. Null in, null out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Accented vowels that count as letters and vowels.
SMALL_VOWELS = "àáâãäåāăąǎȁȃȧạảấầẩẫậắằẳẵặèéêëēĕėęěȅȇẹẻẽếềểễệìíîïĩīĭįǐȉȋỉịòóôõöøōŏőǒȍȏȯọỏốồổỗộơớờởỡợùúûüũūŭůűųǔǖǘǚǜȕȗụủưứừửữự"
ACCENTED_VOWELS = SMALL_VOWELS + "".join(c for c in SMALL_VOWELS.upper() if c not in SMALL_VOWELS)


def collapse_whitespace(c: Column) -> Column:
    """Runs of Unicode whitespace to one space, trimmed."""
    return F.regexp_replace(F.regexp_replace(c, r"(?U)\s+", " "), "^ | $", "")


def normalize_for_repetition(c: Column) -> Column:
    """Collapsed, lower case, each run of digits as '#'."""
    return F.regexp_replace(F.lower(collapse_whitespace(c)), "[0-9]+", "#")


def _kept(c: Column, ascii_: str, beyond: str) -> Column:
    """Characters of a class: those of ASCII, and of what is left of a text without ASCII those of a class of hundreds, which is asked for
    few characters so."""
    own = F.char_length(F.regexp_replace(c, f"[^{ascii_}]+", ""))
    other = F.char_length(F.regexp_replace(F.regexp_replace(c, r"[\x00-\x7f]+", ""), f"[^{beyond}]+", ""))
    return own + F.when(F.octet_length(c) == F.char_length(c), 0).otherwise(other)


def letter_count(c: Column) -> Column:
    return _kept(c, "A-Za-z", ACCENTED_VOWELS)


def vowel_count(c: Column) -> Column:
    return _kept(c, "AEIOUaeiou", ACCENTED_VOWELS)


def control_count(c: Column) -> Column:
    return F.regexp_count(c, F.lit(r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f]"))


def visible_count(c: Column) -> Column:
    return F.char_length(F.regexp_replace(c, r"[\s\x00-\x1f\x7f-\x9f]+", ""))


def private_use_count(c: Column) -> Column:
    return F.regexp_count(c, F.lit(r"[\x{E000}-\x{F8FF}]"))


def combining_count(c: Column) -> Column:
    return F.regexp_count(c, F.lit(r"[\x{0300}-\x{036F}]"))


def rtl_count(c: Column) -> Column:
    """Strong right-to-left characters."""
    return F.regexp_count(c, F.lit(r"[\x{0590}-\x{08FF}\x{FB1D}-\x{FDFF}\x{FE70}-\x{FEFC}]"))


#: Ranges of scripts whose letters stand side by side without capitals, as a character class.
COMPLEX = r"\x{0590}-\x{06FF}\x{0750}-\x{077F}\x{08A0}-\x{0EFF}\x{1000}-\x{109F}\x{1780}-\x{17FF}\x{FB1D}-\x{FDFF}\x{FE70}-\x{FEFF}"
#: Signs that broken font maps put between letters.
SYMBOLS = "$¥©«»@¢£¤¦§¨ª¬®¯¶¸º¼½¾¿"
#: Letters of scripts that a word does not mix, by name; Latin, East Asian and all other letters are left out.
SCRIPTS = {
    "greek": r"\x{0370}-\x{03FF}\x{1F00}-\x{1FFF}\x{2C80}-\x{2CFF}", "cyrillic": r"\x{0400}-\x{052F}\x{1C80}-\x{1C8F}\x{2DE0}-\x{2DFF}\x{A640}-\x{A69F}", "armenian": r"\x{0530}-\x{058F}",
    "hebrew": r"\x{0590}-\x{05FF}\x{FB1D}-\x{FB4F}", "arabic": r"\x{0600}-\x{06FF}\x{0750}-\x{077F}\x{0860}-\x{08FF}\x{FB50}-\x{FDFF}\x{FE70}-\x{FEFF}", "indic": r"\x{0900}-\x{0DFF}",
    "thai": r"\x{0E00}-\x{0E7F}", "lao": r"\x{0E80}-\x{0EFF}", "tibetan": r"\x{0F00}-\x{0FFF}", "burmese": r"\x{1000}-\x{109F}", "georgian": r"\x{10A0}-\x{10FF}", "ethiopic": r"\x{1200}-\x{139F}", "khmer": r"\x{1780}-\x{17FF}",
}


def complex_count(c: Column) -> Column:
    return F.regexp_count(c, F.lit(f"[{COMPLEX}]"))


def script_intrusions(c: Column) -> Column:
    """Printable ASCII characters wedged between letters of a complex script; neighbours may share one."""
    return F.when(c.rlike(f"[{COMPLEX}]"), F.regexp_count(c, F.lit(f"(?<=[{COMPLEX}])[!-~](?=[{COMPLEX}])"))).otherwise(F.when(c.isNotNull(), 0))


def symbol_intrusions(c: Column) -> Column:
    """Signs wedged between letters."""
    return F.when(c.rlike(f"[{SYMBOLS}]"), F.regexp_count(c, F.lit(rf"(?<=\p{{L}})[{SYMBOLS}](?=\p{{L}})"))).otherwise(F.when(c.isNotNull(), 0))


def all_letters(c: Column) -> Column:
    return F.char_length(F.regexp_replace(c, r"[^\p{L}]", ""))


#: Characters beside the blank that end a token.
ODD_BLANKS = r"[\p{Cc}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def tokens(c: Column) -> Column:
    """Blank-free tokens of a text, control characters taken as blanks."""
    return F.filter(F.split(F.when(c.rlike(ODD_BLANKS), F.regexp_replace(c, ODD_BLANKS, " ")).otherwise(c), " "), lambda t: t != "")


def judged_count(c: Column) -> Column:
    """How many `judged_tokens` a text has, by one pattern without taking it apart."""
    plain = F.when(c.rlike(ODD_BLANKS), F.regexp_replace(c, ODD_BLANKS, " ")).otherwise(c)
    return F.regexp_count(plain, F.lit(r"(?<![^ ])(?![^ ]*[$\\])(?=[^ ]*\p{L}[^ ]*\p{L})[^\p{L}\p{N} ]*[\p{L}\p{N}][^ ]+[\p{L}\p{N}][^\p{L}\p{N} ]*(?![^ ])"))


def judged_tokens(c: Column) -> Column:
    """Tokens without signs at their ends that have three characters and two letters; formulas (with $ or a backslash) are none."""
    bare = F.transform(F.filter(tokens(c), lambda t: ~t.rlike(r"[$\\]")), lambda t: F.regexp_replace(t, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", ""))
    return F.filter(bare, lambda t: (F.char_length(t) >= 3) & t.rlike(r"\p{L}.*\p{L}"))


def malformed(t: Column) -> Column:
    """Whether a token has capitals inside small letters twice or before a short end, ';' or '=' between letters, letters of two
    scripts, or an accented Latin letter beside one of another script."""
    flips = ~t.rlike("[_./@]") & ((F.regexp_count(t, F.lit(r"(?<=\p{Ll})\p{Lu}(?=\p{Ll})")) >= 2) | t.rlike(r"\p{Ll}\p{Lu}\p{Ll}{1,2}(?!\p{Ll})"))
    count = F.lit(0)
    for own in SCRIPTS.values():
        count = count + t.rlike(f"[{own}]").cast("int")
    other = "".join(SCRIPTS.values())
    accented = r"\x{00C0}-\x{00D6}\x{00D8}-\x{00F6}\x{00F8}-\x{024F}"
    mixed = t.rlike(f"[{other}]") & ((count >= 2) | t.rlike(f"[{accented}][{other}]|[{other}][{accented}]"))
    return flips | t.rlike(r"\p{L}[;=]\p{L}") | mixed


def malformed_count(c: Column) -> Column:
    """How many judged tokens of a text are malformed. Texts without any sign of one are not taken apart."""
    sign = rf"\p{{Ll}}\p{{Lu}}\p{{Ll}}|\p{{L}}[;=]\p{{L}}|[{''.join(SCRIPTS.values())}]"
    return F.when(c.rlike(sign), F.size(F.filter(judged_tokens(c), malformed))).otherwise(0)


#: Parts and beginnings of the names of fonts for signs and formulas.
SYMBOL_PARTS = "wingding|webding|dingbat|symbol|zapf|math|sym|greekwith"
SYMBOL_STARTS = "cmex|cmsy|cmmi|msam|msbm|rtxm|rtxs|txex|txsy|xyatip|xydash|eufm|esint|stmary|wasy"


def base_font(c: Column) -> Column:
    """A font's name without the tag of its subset."""
    return F.regexp_replace(c, r"^[^+]*\+", "")


def is_symbol_font(c: Column) -> Column:
    return F.coalesce(F.lower(base_font(c)).rlike(f"{SYMBOL_PARTS}|^({SYMBOL_STARTS})"), F.lit(False))


#: Fixed patterns: what single lines of running chrome look like.
CHROME = (
    r"https?://|www\.|doi\.org|©|^copyright |^\(c\) ",
    r"^page [0-9]+( of [0-9]+)?$",
    r"^[0-9]{1,4}$",
    r"(^|[^a-z])vol\.? ?[0-9]+",
)
_YEAR, _RANGE = r"(^|[^0-9])(19|20)[0-9]{2}([^0-9-]|$)", r"(^|[^0-9-])[0-9]{1,4}[-–][0-9]{1,4}([^0-9-]|$)"


def is_chrome(c: Column) -> Column:
    """URL, copyright, page or volume marker, a bare number, or a year with a range of numbers in a short line."""
    s = F.lower(collapse_whitespace(c))
    found = F.lit(False)
    for pattern in CHROME:
        found = found | s.rlike(pattern)
    return found | ((F.octet_length(s) <= 120) & s.rlike(_YEAR) & s.rlike(_RANGE))


def hyphen_kind(c: Column) -> Column:
    """How a line ends: 'soft' (hyphen directly after a letter), 'open' (hyphen and blanks), 'none'."""
    return F.when(c.rlike(r"\p{L}-$"), "soft").when(c.rlike(r"-\s*$"), "open").otherwise("none")


def ends_sentence(c: Column) -> Column:
    return c.rlike("[.!?:][\"”’)\\]]*\\s*$")


def dehyphenate_join(left: Column, right: Column) -> Column:
    """Two lines as one: a soft hyphen before a small letter goes, another hyphen stays, else a space comes between."""
    bare = F.regexp_replace(left, r"\s+$", "")
    start = F.regexp_replace(right, r"^\s+", "")
    return (
        F.when(bare.rlike(r"\p{L}-$") & start.rlike(r"^\p{Ll}"), F.concat(F.regexp_replace(bare, "-$", ""), start))
        .when(bare.rlike("-$"), F.concat(bare, start))
        .otherwise(F.concat_ws(" ", bare, start))
    )


SECTION = r"^(?:(?:Sec|Section|Ch|Chapter|Part|§)\.?\s+)?([0-9]+(?:\.[0-9]+)*)[.)]?\s+\S"
CAPTION = r"(?i)^(figure|fig\.?|table|chart|scheme|plate|exhibit|abbildung|tabelle|tableau|figura|tabla)\s+[0-9]+"
TOC = r"^(.*[^0-9\s].*?)[\s.]*\s([0-9]{1,4})$"
BULLET = r"^\s*([•◦▪‣∙·*–-])\s+(\S.*)$"
NUMBERED = r"^\s*([0-9]{1,3}[.)])\s+(\S.*)$"


def section_number(c: Column) -> Column:
    """Dotted number that begins a heading, '' for none."""
    return F.regexp_extract(c, SECTION, 1)


def is_caption(c: Column) -> Column:
    return c.rlike(CAPTION)


def toc_page(c: Column) -> Column:
    """Page number of a line of a table of contents, null for another line: at least 8 letters, then up to 4 digits."""
    body = F.regexp_extract(c, TOC, 1)
    # the end first: without digits there the whole pattern would try every split of a long line
    return F.when(c.rlike(r"\s[0-9]{1,4}$") & c.rlike(TOC) & (F.char_length(F.regexp_replace(body, r"[^\p{L}]", "")) >= 8), F.regexp_extract(c, TOC, 2).cast("int"))


def toc_roman(c: Column) -> Column:
    """Whether a line of at least 5 letters ends in a blank and a roman number of 2 to 6 letters."""
    tail = r"^(.*?)[\s.]*\s[\s.]*[ivxlcdmIVXLCDM]{2,6}$"
    letters = F.char_length(F.regexp_replace(F.regexp_extract(F.trim(c), tail, 1), r"[^\p{L}]", ""))
    return F.coalesce(F.trim(c).rlike(r"\s[ivxlcdmIVXLCDM.\s]*[ivxlcdmIVXLCDM]{2,6}$") & F.trim(c).rlike(tail) & (letters >= 5), F.lit(False))


#: Titles of pages of contents.
TOC_TITLES = ("contents", "table of contents", "table of content", "index", "list of figures", "list of tables", "table of figures", "toc")
#: Fixed pattern: how a line that says where something comes from begins.
ATTRIBUTION = r"(?i)^(source|sources|note|notes|credit|photo|image courtesy|courtesy|quelle|quellen|fuente|fuentes|crédit|crédits)\s*(:|of\b|by\b)"


def is_toc_title(c: Column) -> Column:
    return F.lower(F.regexp_replace(F.trim(c), ":+$", "")).isin(*TOC_TITLES)


def is_attribution(c: Column) -> Column:
    return F.trim(c).rlike(ATTRIBUTION)


def list_marker(c: Column) -> Column:
    """'bullet', 'ordered' or null."""
    return F.when(c.rlike(BULLET), "bullet").when(c.rlike(NUMBERED), "ordered")


def list_body(c: Column) -> Column:
    return F.when(c.rlike(BULLET), F.regexp_extract(c, BULLET, 2)).when(c.rlike(NUMBERED), F.regexp_extract(c, NUMBERED, 2))


def divider_kind(c: Column) -> Column:
    """A line of divider glyphs only: 'rule' of three or more, 'drop' of fewer; null for other lines."""
    s = F.regexp_replace(c, r"\s", "")
    return F.when(s.rlike(r"^[-_=*~─━—–.•]+$"), F.when(F.char_length(s) >= 3, "rule").otherwise("drop"))


def value_shape(c: Column) -> Column:
    """Kind of a short cell: number, page reference, bullet, equation number, label, text."""
    s = F.trim(c)
    return (
        F.when(s.rlike(r"^[-+(]?[$€£]?[0-9][0-9.,]*%?\)?$"), "number")
        .when(s.rlike(r"^(p|pp|page|S)\.? ?[0-9]+$"), "page-ref")
        .when(s.rlike("^[•◦▪‣∙·*–-]$"), "bullet")
        .when(s.rlike(r"^\([0-9]+(\.[0-9]+)*\)$"), "equation")
        .when(s.rlike(r":$"), "label")
        .otherwise("text")
    )


_CORE = r"^[0-9,.% +*/-]*[0-9][0-9,.% +*/-]*$|^N/A$|^Z$|^-$"


def clean_recognised(c: Column) -> Column:
    """Table borders read as characters go from both ends of what is numeric; brackets directly around a number stay."""
    s = F.trim(c)
    outer = F.regexp_replace(F.regexp_replace(s, r"^[|\[\]{}\s]+", ""), r"[|\[\]{}\s]+$", "")
    core = F.regexp_replace(F.regexp_replace(outer, r"^[|\[\](){}\s]+", ""), r"[|\[\](){}\s]+$", "")
    return F.when(core.rlike(_CORE), F.when(outer.startswith("(") & outer.endswith(")"), F.concat(F.lit("("), core, F.lit(")"))).otherwise(core)).otherwise(s)


def escape_markdown(c: Column) -> Column:
    """Backslash before '*', '\\' and underscores that are not inside a word."""
    s = F.regexp_replace(c, r"([*\\])", r"\\$1")
    return F.regexp_replace(s, r"(?<![A-Za-z0-9])_|_(?![A-Za-z0-9])", r"\\_")


def code_language(c: Column) -> Column:
    """Hint by counts of telling signs: json, cpp, python or ''."""

    def signs(*words: str) -> Column:
        total = F.lit(0)
        for w in words:
            total = total + F.contains(c, F.lit(w)).cast("int")
        return total

    json, cpp, python = signs('{"', '":', "[{"), signs("#include", "std::", "int main", "->"), signs("def ", "import ", "self.", "print(")
    return F.when((json >= 2) & (json >= cpp) & (json >= python), "json").when((cpp >= 2) & (cpp >= python), "cpp").when(python >= 2, "python").otherwise("")


def content_length(c: Column) -> Column:
    """Characters without code fences, dividers of five hyphens and whitespace."""
    return F.char_length(F.regexp_replace(F.regexp_replace(c, r"```[a-z]*|-----", ""), r"\s", ""))


def font_style(name: Column, weight: Column, flags: Column) -> Column:
    """Struct of bold, italic, mono, symbol, subset of a font's name, weight and descriptor flags."""
    n = F.lower(F.coalesce(name, F.lit("")))
    f = F.coalesce(flags, F.lit(0))
    return F.struct(
        ((F.coalesce(weight, F.lit(0)) >= 600) | (f.bitwiseAND(262144) != 0) | n.rlike("bold|black|heavy")).alias("bold"),
        ((f.bitwiseAND(64) != 0) | n.rlike("italic|oblique")).alias("italic"),
        ((f.bitwiseAND(1) != 0) | n.rlike("mono|courier|consol")).alias("mono"),
        n.rlike("symbol|wingding|dingbat|cmsy|cmmi|cmex").alias("symbol"),
        F.coalesce(name, F.lit("")).rlike(r"^[A-Z]{6}\+").alias("subset"),
    )
