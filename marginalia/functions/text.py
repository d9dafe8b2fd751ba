"""Text functions on columns (names, PII, snippets, escapes)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A run of letters, marks, digits and underscores in any script, and anything between such runs.
WORD, TOKENS = r"[\p{L}\p{M}\p{N}_]+", r"[\p{L}\p{M}\p{N}_]+|[^\p{L}\p{M}\p{N}_]+"
PLACEHOLDER, REDACTED = "[STUDENT_NAME]", "[REDACTED]"

# fixed values: what counts as personal data, as a header and as a continuation
EMAIL = r"[a-zA-Z0-9_.+-]+@[a-zA-Z0-9-]+\.[a-zA-Z0-9-.]+"
TITLE_PAIR = r"(?<![\p{L}\p{M}\p{N}_])[A-Z][a-z]+ [A-Z][a-z]+(?![\p{L}\p{M}\p{N}_])"
NAME_HEADER = r"(?im)^\s*(?:name|id)\s*[:\-]\s*(\p{L}[\p{L}'-]*(?:\s+\p{L}[\p{L}'-]*)?)"
CONTINUE_HEADER = r"(?im)^\s*continue\s*[:\-]\s*(.+)$"

# fixed values: LaTeX escapes of single characters
LATEX = {
    "\\": "\\textbackslash{}",
    "{": "\\{",
    "}": "\\}",
    "&": "\\&",
    "%": "\\%",
    "$": "\\$",
    "#": "\\#",
    "_": "\\_",
    "~": "\\textasciitilde{}",
    "^": "\\textasciicircum{}",
}


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def collapse_space(x) -> Column:
    return F.trim(F.regexp_replace(_c(x), r"\s+", " "))


def normal_name(x) -> Column:
    """Lower case, white space collapsed."""
    return F.lower(collapse_space(x))


def name_parts(x, least: int = 2) -> Column:
    """Distinct parts of a name; hyphens and underscores separate."""
    return F.array_distinct(F.filter(F.split(F.translate(F.lower(_c(x)), "-_", "  "), r"\s+"), lambda p: F.length(p) >= least))


def words(x) -> Column:
    return F.filter(F.split(_c(x), r"\s+"), lambda w: w != "")


def word_count(x) -> Column:
    return F.size(words(x)).cast("long")


def replace_tokens(x, is_name, placeholder: str = PLACEHOLDER) -> Column:
    """Every token for whose lower case ``is_name`` holds becomes the
    placeholder.  Tokens are whole words in any script."""
    tokens = F.regexp_extract_all(_c(x), F.lit(TOKENS), F.lit(0))
    return F.array_join(F.transform(tokens, lambda t: F.when(is_name(F.lower(t)), placeholder).otherwise(t)), "")


def redact_pii(x) -> Column:
    """E-mail addresses and pairs of capitalised ASCII words."""
    whole = F.regexp_replace(_c(x), f"{EMAIL}|{TITLE_PAIR}", REDACTED)
    # an address is looked for at every letter, so only in texts that can have one
    return F.when(F.contains(_c(x), F.lit("@")), whole).otherwise(F.regexp_replace(_c(x), TITLE_PAIR, REDACTED))


def truncate(x, most: int = 180) -> Column:
    t = F.trim(_c(x))
    return F.when(F.length(t) > most, F.concat(F.substring(t, 1, most), F.lit("…"))).otherwise(t)


def preview(x, most: int = 300) -> Column:
    t = _c(x)
    return F.when(F.length(t) > most, F.concat(F.substring(t, 1, most), F.lit("..."))).otherwise(t)


def first_lines(x, n: int) -> Column:
    return F.array_join(F.slice(F.split(_c(x), "\n"), 1, n), "\n")


def snippet(x, query: str, around: int = 30) -> Column:
    """Text around the first hit of ``query`` in any case, in dots.  Without a
    hit it is the text's beginning, as a search from -1 gives it."""
    t = F.coalesce(_c(x), F.lit(""))
    at = F.locate(query.lower(), F.lower(t)) - 1
    start = F.greatest(F.lit(0), at - around)
    end = F.least(F.length(t), at + len(query) + around)
    return F.concat(F.lit("..."), F.substring(t, start + 1, F.greatest(F.lit(0), end - start)), F.lit("..."))


def holds(x, query: str) -> Column:
    """Literal substring in any case; null holds nothing."""
    return F.coalesce(F.contains(F.lower(_c(x)), F.lit(query.lower())), F.lit(False))


def like(x, query: str) -> Column:
    """Substring with the wildcards ``%`` and ``_`` of the query."""
    return F.coalesce(_c(x).ilike(f"%{query}%"), F.lit(False))


def match_reason(query: str, *ladder: tuple[str, str], rest: str = "Content Match") -> Column:
    """Name of the first column of ``ladder`` that holds the query."""
    out = None
    for column, reason in ladder:
        out = F.when(holds(column, query), reason) if out is None else out.when(holds(column, query), reason)
    return F.lit(rest) if out is None else out.otherwise(rest)


def top_section(x, lines: int = 10) -> Column:
    return F.array_join(F.slice(F.split(_c(x), r"\r\n|\r|\n"), 1, lines), "\n")


def header_name(x, roster: Column | None = None) -> Column:
    """Name in a ``Name:`` or ``ID:`` header of the first ten lines, else the
    first of these lines that is a roster name as a whole (``roster``: array
    of normal names), else null."""
    top = top_section(x)
    found = F.nullif(collapse_space(F.regexp_extract(top, NAME_HEADER, 1)), F.lit(""))
    if roster is None:
        return found
    line = F.filter(F.split(top, "\n"), lambda s: F.array_contains(roster, F.lower(F.trim(F.regexp_replace(s, r"\s+", " ")))))
    return F.coalesce(found, collapse_space(F.get(line, 0)))


def continuation_name(x) -> Column:
    return F.nullif(F.trim(F.regexp_extract(top_section(x), CONTINUE_HEADER, 1)), F.lit(""))


def normal_pdf_text(x) -> Column:
    """Three or more line ends are a paragraph, single ones a space."""
    t = F.regexp_replace(_c(x), r"(?:\s*\n){3,}", "\n\n")
    t = F.regexp_replace(t, r"(?<!\n)\n(?!\n)", " ")
    return F.regexp_replace(F.regexp_replace(t, r" {2,}", " "), r"^\s+|\s+$", "")


def escape_html(x) -> Column:
    """``&`` first, then angle brackets and quotes."""
    t = _c(x)
    for raw, ref in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        t = F.replace(t, F.lit(raw), F.lit(ref))
    return t


def html_paragraphs(x) -> Column:
    """Paragraphs of a text in ``<p>``, line ends as ``<br>``."""
    paragraphs = F.filter(F.transform(F.split(escape_html(x), r"\n\s*\n"), lambda p: F.trim(p)), lambda p: p != "")
    return F.array_join(F.transform(paragraphs, lambda p: F.concat(F.lit("<p>"), F.replace(p, F.lit("\n"), F.lit("<br>")), F.lit("</p>"))), "\n")


def escape_latex(x) -> Column:
    """Each character once, so that no escape is escaped again."""
    table = F.create_map(*[F.lit(v) for kv in LATEX.items() for v in kv])
    return F.array_join(F.transform(F.split(_c(x), ""), lambda c: F.coalesce(F.element_at(table, c), c)), "")


def fill_template(template: str, values: dict[str, Column], escape: bool = True) -> Column:
    """``{{name}}`` placeholders of a template with (escaped) columns."""
    out = F.lit(template)
    for name, value in values.items():
        out = F.replace(out, F.lit("{{" + name + "}}"), F.coalesce(escape_latex(value) if escape else value, F.lit("")))
    return out


def safe_name(x, most: int | None = None) -> Column:
    """Letters, digits, underscore and hyphen; anything else an underscore."""
    t = F.regexp_replace(_c(x), r"[^A-Za-z0-9_-]", "_")
    t = F.regexp_replace(t, r"^_+|_+$", "")
    return F.substring(t, 1, most) if most else t


def split_answers(x) -> Column:
    """Comma-separated options, trimmed and lower-cased, without blanks."""
    return F.filter(F.transform(F.split(F.coalesce(_c(x), F.lit("")), ","), lambda t: F.lower(F.trim(t))), lambda t: t != "")


def first_filled(*xs) -> Column:
    """First value that is neither null nor empty."""
    return F.coalesce(*[F.nullif(_c(x).cast("string"), F.lit("")) for x in xs])


def json_span(x) -> Column:
    """Source of the first JSON value in free text: in a code fence, else from
    the first bracket to the last one that closes it; null without one."""
    t = _c(x)
    fenced = F.regexp_extract(t, r"(?s)```(?:json)?\s*([\[{].*?[\]}])\s*```", 1)
    obj, arr = F.locate("{", t), F.locate("[", t)
    as_list = (arr > 0) & ((obj == 0) | (arr < obj))
    start = F.when(as_list, arr).otherwise(obj)
    last = F.length(t) - F.locate("]", F.reverse(t)) + 1
    last_obj = F.length(t) - F.locate("}", F.reverse(t)) + 1
    closer = F.when(as_list, F.contains(t, F.lit("]"))).otherwise(F.contains(t, F.lit("}")))
    end = F.when(as_list, last).otherwise(last_obj)
    bare = F.when((start > 0) & closer & (end > start), F.substring(t, start, end - start + 1))
    return F.trim(F.coalesce(F.nullif(fenced, F.lit("")), bare))


def lenient_json(x) -> Column:
    """The first JSON value in free text as a VARIANT; trailing commas go if
    it doesn't parse without; null if neither parses."""
    span = json_span(x)
    return F.coalesce(F.try_parse_json(span), F.try_parse_json(F.regexp_replace(span, r",\s*([\]}])", "$1")))
