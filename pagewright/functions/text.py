"""Text clean-up as Column functions.

Every function takes and returns Columns and stays inside the JVM. Java's regular
expressions are ASCII by default, so ``(?U)`` marks the places that must see Unicode.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Line breaks in the sense of Unicode text: the pair first, then each single one.
LINE_BREAK = r"\r\n|[\n\r\x0B\x0C\x1C\x1D\x1E\x85  ]"
#: White space at which text is trimmed: Unicode's, and the four ASCII separators.
BLANK = r"[\s\x1C-\x1F]"
#: The same signs one by one: trimming by a set takes one pass without a regular expression.
BLANKS = "".join(map(chr, (*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
#: The range comes first, so that a common letter isn't compared with each sign.
_NOISE = "©®°§¶[\u2020-\u26FF&&[" + "".join(sorted("™†‡•◦▪▫●○◆◇★☆♦♠♣♥")) + "]]"


def strip(text: Column) -> Column:
    """Trim Unicode white space from both ends."""
    return F.btrim(text, F.lit(BLANKS))


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _strip_lines(text: Column) -> Column:
    return F.array_join(F.transform(_lines(text), strip), "\n")


def normalize_whitespace(text: Column) -> Column:
    """Trim every line, keep one blank line of a run, trim the whole."""
    return strip(F.regexp_replace(_strip_lines(text), r"\n{3,}", "\n\n"))


def normalize_text(text: Column, collapse_blanks: bool = True) -> Column:
    """Drop control characters but tab and line ends; optionally collapse blanks; tidy lines."""
    clean = F.regexp_replace(text, r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x9F]", "")
    if collapse_blanks:
        clean = F.regexp_replace(clean, " +", " ")
    return normalize_whitespace(clean)


def merge_hyphenated_words(text: Column) -> Column:
    """Rejoin words that a line end cut at a hyphen."""
    return F.regexp_replace(text, r"(?U)(\w+)-\s*\n\s*(\w+)", "$1$2")


def clean_artifacts(text: Column) -> Column:
    """Isolated bullets, blanks before punctuation, runs of dots."""
    t = F.regexp_replace(text, "(?U)\\s[•·∙■□▪▫]\\s", " ")
    t = F.regexp_replace(t, r"(?U)\s+([!,.:;?])", "$1")
    return F.regexp_replace(t, r"\.{3,}", "...")


def sentences(text: Column) -> Column:
    """Array of sentences: cut after . ! ? before a capital, trimmed, none empty."""
    cut = F.split(text, r"(?U)(?<=[!.?])\s+(?=[À-ÚA-Z])")
    return F.filter(F.transform(cut, strip), lambda s: s != "")


def clean_ocr_text(text: Column) -> Column:
    """Remove recognition noise; keep lines with at least two letters. Null gives ''."""
    t = F.regexp_replace(F.coalesce(text, F.lit("")), rf"[\[\]{{}}<>\\|{_NOISE}]", "")
    t = F.regexp_replace(t, r"([#*\-=_~])\1{3,}", "")
    # A run of blanks is tried from its first one only, and a single blank isn't replaced by itself.
    t = F.regexp_replace(t, r"(?U)\s(?<!\s\s)\s*+([!),.:;?])", "$1")
    t = F.regexp_replace(t, r"([!,.:;?])([a-zà-úA-ZÀ-Ú])", "$1 $2")
    t = F.regexp_replace(t, r"\t[\t ]*| [\t ]+", " ")
    lines = F.filter(F.transform(_lines(t), strip), lambda s: s.rlike(r"[a-zA-ZÀ-ú][^a-zA-ZÀ-ú]*+[a-zA-ZÀ-ú]"))
    return strip(F.array_join(lines, "\n"))


def remove_short_lines(text: Column, min_length: int = 3) -> Column:
    """Drop lines whose trimmed length is below ``min_length``."""
    return F.array_join(F.filter(_lines(text), lambda s: F.length(strip(s)) >= min_length), "\n")


#: Look-alike repairs in their order, each led by its letter, so that all other places fail at
#: once. Two rules of the behaviour that this mirrors map a word to itself and two can never
#: fire (a word's end between two letters is one of them); they are left out.
OCR_REPAIRS = (
    (r"l<", "k"),
    (r"O(?=\p{Lower})(?<=\p{Lower}O)", "o"),
    (r"o(?=\p{Upper})(?<=\p{Upper}o)", "O"),
    (r"0(?=\p{Alpha})(?<=\p{Alpha}0)", "O"),
    (r"O(?=\p{Digit})(?<=\p{Digit}O)", "0"),
    (r"1(?=\p{Alpha})(?<=\p{Alpha}1)", "l"),
    (r"l(?=\p{Digit})(?<=\p{Digit}l)", "1"),
    (r"(?U)NQ\b(?<=\bNQ)", "Nº"),
    (r"(?U)n2\b(?<=\bn2)", "nº"),
)


def fix_ocr_errors(text: Column) -> Column:
    for pattern, new in OCR_REPAIRS:
        text = F.regexp_replace(text, pattern, new)
    return text


def _is_upper(word: Column) -> Column:
    """At least one cased letter and none in lower case."""
    return (F.upper(word) == word) & (F.lower(word) != word)


def _merge_line(line: Column) -> Column:
    """Each word becomes a letter for its length and case; on those, a line's pairs are one replacement."""
    by_length = lambda w, one, two, more: F.when(F.length(w) == 1, one).when(F.length(w) == 2, two).otherwise(more)
    letter = lambda w: F.when(_is_upper(w), by_length(w, "A", "B", "C")).otherwise(by_length(w, "a", "b", "c"))

    def merged(words: Column) -> Column:
        marks = F.regexp_replace(F.array_join(F.transform(words, letter), ""), "[AB][BC]|[ab][bc]", "+.")
        spaced = F.zip_with(words, F.split(marks, ""), lambda w, m: F.when(m == "+", w).otherwise(F.concat(w, F.lit(" "))))
        return F.when(F.size(words) < 2, line).otherwise(F.rtrim(F.array_join(spaced, "")))

    return bind(F.filter(F.split(line, rf"(?U){BLANK}+"), lambda w: w != ""), merged)


def merge_broken_words(text: Column) -> Column:
    """Join a word of one or two letters with the next one of like case, pairwise from the left."""
    return F.array_join(F.transform(_lines(text), _merge_line), "\n")


def postprocess_ocr(text: Column, clean: bool = True, fix: bool = True, merge: bool = False, min_line: int = 3) -> Column:
    """The whole clean-up; null gives ''."""
    t = F.coalesce(text, F.lit(""))
    if clean:
        t = clean_ocr_text(t)
    if fix:
        t = fix_ocr_errors(t)
    if merge:
        t = merge_broken_words(t)
    if min_line > 0:
        t = remove_short_lines(t, min_line)
    return normalize_whitespace(t)


def strip_leading_hash(text: Column) -> Column:
    """Drop a recognition hash such as '.dBmu9HEi ' at the start."""
    return F.regexp_replace(text, r"(?U)^\.[0-9A-Za-z]{6,12}\s+", "")


def truncate(text: Column, limit: int, mark: str = "... [truncado]") -> Column:
    """Cut to ``limit`` characters and say so; 0 switches it off."""
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit(mark))).otherwise(text) if limit else text


def embedding_input(text: Column, limit: int = 6000) -> Column:
    return F.substring(text, 1, limit)


def strip_tool_markup(text: Column) -> Column:
    """Remove tool-call blocks from an answer."""
    t = F.regexp_replace(text, r"(?s)<tool_call>.*?</tool_call>", "")
    return strip(F.regexp_replace(t, r"\n{3,}", "\n"))


def estimated_chars(content: Column, calls: Column) -> Column:
    """Characters of a message: its content and the names and arguments of its calls."""
    size = F.aggregate(F.coalesce(calls, F.array().cast("array<struct<name:string,arguments:string>>")), F.lit(0), lambda n, c: n + F.length(F.coalesce(c["name"], F.lit(""))) + F.length(F.coalesce(c["arguments"], F.lit(""))))
    return F.length(F.coalesce(content, F.lit(""))) + size


def repeated_margin_lines(lines: Column, min_repeats: int = 3) -> Column:
    """Lines without headers and footers: texts among the first or last five that recur.

    Fewer than twice ``min_repeats`` lines are left alone; blank lines stay. Counting is
    by value, once for each of the ten margin lines, so it is linear in a page's lines.
    """
    def kept(trimmed: Column) -> Column:
        margin = F.array_distinct(F.concat(F.slice(trimmed, 1, 5), F.slice(trimmed, F.greatest(F.size(trimmed) - 4, F.lit(1)), 5)))
        often = F.filter(margin, lambda m: (m != "") & (F.size(F.filter(trimmed, lambda t: t == m)) >= min_repeats))
        pairs = F.arrays_zip(lines.alias("x"), trimmed.alias("t"))
        return bind(often, lambda o: F.transform(F.filter(pairs, lambda p: ~F.array_contains(o, p["t"])), lambda p: p["x"]))

    return F.when(F.size(lines) < 2 * min_repeats, lines).otherwise(bind(F.transform(lines, strip), kept))


def bind(value: Column, use) -> Column:
    """``use(value)`` with the value computed once; inside a lambda it would be computed for every element."""
    return F.element_at(F.transform(F.array(value), lambda v: use(v)), 1)


def cell_text(cell: Column) -> Column:
    """A table cell on one line; null gives ''."""
    return strip(F.regexp_replace(F.coalesce(cell, F.lit("")), r"(?U)\s+", " "))
