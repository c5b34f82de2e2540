"""Text functions as column expressions, with Python's notion of white space and letters."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from . import patterns as P


def strip(c: Column) -> Column:
    return F.regexp_replace(c, f"^{P.BLANK_J}+|{P.BLANK_J}+$", "")


def filled(c: Column) -> Column:
    """Holds anything but white space."""
    return c.rlike(f"[^{P.BLANK_J[1:]}")


def lines(c: Column) -> Column:
    return F.split(c, "\n", -1)


def inked(c: Column) -> Column:
    """The lines that are not blank."""
    return F.filter(lines(c), filled)


def letters(c: Column) -> Column:
    """Number of letters and digits."""
    return F.regexp_count(c, F.lit(r"[\p{L}\p{N}]"))


def content_amount(c: Column) -> Column:
    """Letters and digits outside of markup."""
    return letters(F.regexp_replace(c, P.MARKUP_J, " "))


def bare(c: Column) -> Column:
    """A line without its outer white space and emphasis marks."""
    return F.regexp_replace(strip(c), "^[*_# ]+|[*_# ]+$", "")


def head_form(c: Column) -> Column:
    """What stays the same of a running head from page to page."""
    return F.lower(strip(F.regexp_replace(F.regexp_replace(bare(c), r"\p{Nd}+", "#"), f"{P.BLANK_J}+", " ")))


def head_like(c: Column) -> Column:
    s = bare(c)
    return (F.char_length(s).between(1, P.HEAD_LENGTH)) & ~s.rlike(r"[.,;:!?]$") & ~s.contains("<sup>") & ~s.contains("[^") & ~s.contains("](")


def local_head_like(c: Column) -> Column:
    return head_like(c) & ~strip(c).rlike(P.STRUCTURE_J)


def title_key(c: Column) -> Column:
    return F.regexp_replace(F.lower(F.replace(c, F.lit("\u00ad"), F.lit(""))), r"[^\p{L}\p{N}]+", "")


def clean_title(c: Column) -> Column:
    """A heading as a file name; cut at a word."""
    t = F.when(c.rlike(P.HEADING_J), F.regexp_extract(c, P.HEADING_J, 2)).otherwise(c)
    for pattern, to in ((r"<sup>.*?</sup>|<sub>.*?</sub>|\[\^[^\]]*\]", ""), (r"!?\[([^\]]*)\]\([^)]*\)", "$1"), (r"<[^>]+>", ""), (r'[\\/:*?"<>|#^\[\]`*_~]', " "), (f"{P.BLANK_J}+", " ")):
        t = F.regexp_replace(t, pattern, to)
    t = strip(t)
    short = F.regexp_replace(F.substring(t, 1, P.TITLE_MOST + 1), "(?s) [^ ]*$", "")
    return F.regexp_replace(F.when(F.char_length(t) > P.TITLE_MOST, short).otherwise(t), "[ .]+$", "")


def markup(c: Column) -> Column:
    """The cross-references that a translation has to keep: sorted note ids and image targets."""
    return F.struct(
        F.sort_array(F.regexp_extract_all(c, F.lit(r"\[\^([^\]]{1,32})\]"), F.lit(1))).alias("notes"),
        F.sort_array(F.regexp_extract_all(c, F.lit(P.IMAGE_J), F.lit(1))).alias("images"),
    )


def unfenced(c: Column) -> Column:
    """An answer without the code fence around it, else stripped."""
    fence = r"(?s)\A\s*```[a-zA-Z]*\n(.*)\n```\s*\z"
    return F.when(c.rlike(fence), F.regexp_extract(c, fence, 1)).otherwise(strip(c))


def page_numbers(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(P.PAGE_ANCHOR_J), F.lit(1))


def page_count(c: Column) -> Column:
    """Distinct page anchors, else an estimate from the length."""
    n = F.size(F.array_distinct(F.transform(page_numbers(c), lambda x: x.cast("int"))))
    return F.when(n > 0, n).otherwise(F.greatest(F.lit(1), F.ceil(F.char_length(c) / P.PAGE_CHARS).cast("int")))


def page_label(first: Column, last: Column) -> Column:
    return F.when(first.isNull(), "").when(first == last, F.concat(F.lit("p. "), first.cast("string"))).otherwise(F.concat(F.lit("pp. "), first.cast("string"), F.lit("–"), last.cast("string")))


def book_prefix(c: Column) -> Column:
    """The last part of an author_year_title name, if long enough to tell."""
    last = strip(F.element_at(F.split(c, "_"), -1))
    return F.when(F.regexp_count(last, F.lit(r"\p{L}")) >= 4, last).otherwise(strip(c))


def chapter_file(prefix: Column, n: Column, title: Column, width: Column) -> Column:
    digits = F.greatest(width, F.char_length(n.cast("string")))
    return F.concat(prefix, F.lit(" "), F.lpad(n.cast("string"), digits, F.lit("0")), F.lit(" "), title, F.lit(".md"))


def chunk_name(first: Column, last: Column) -> Column:
    return F.format_string("%04d-%04d.md", first, last)


def page_range(c: Column) -> Column:
    """'8,40-41' to [8, 40, 41]."""

    def one(part: Column) -> Column:
        ends = F.split(part, "-", 2)
        a, b = F.trim(ends[0]).cast("int"), F.trim(F.element_at(ends, -1)).cast("int")
        return F.when(b >= a, F.sequence(a, b)).otherwise(F.array().cast("array<int>"))

    return F.flatten(F.transform(F.filter(F.transform(F.split(c, ","), strip), lambda x: x != ""), one))


def argument(command: Column, flag: str) -> Column:
    """The word after a flag of a command line; null if there is none."""
    words = F.filter(F.split(command, f"{P.BLANK_J}+"), lambda w: w != "")
    at = F.array_position(words, F.lit(flag)).cast("int")
    return F.when((at > 0) & (at < F.size(words)), F.get(words, at))


def slug(c: Column, default: str = "translated") -> Column:
    s = F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.when(s == "", default).otherwise(s)


def link_part(c: Column) -> Column:
    """Percent-encoding of everything but unreserved characters."""
    e = F.url_encode(c)
    for a, b in (("+", "%20"), ("*", "%2A"), ("%7E", "~")):
        e = F.replace(e, F.lit(a), F.lit(b))
    return e


def link_target(folder: Column, name: Column) -> Column:
    return F.concat(link_part(folder), F.lit("/"), link_part(name))


def chunk_anchors(c: Column, first: Column) -> Column:
    """Link targets of a chunk with its first page in front; twice is once."""
    return F.regexp_replace(c, F.lit(P.CHUNK_TARGET_J), F.concat(F.lit("$1c"), F.lpad(first.cast("string"), F.greatest(F.lit(4), F.char_length(first.cast("string"))), F.lit("0")), F.lit("-$2")))


def human_seconds(s: Column) -> Column:
    return F.when(s < 90, F.format_string("~%.0f seconds", s)).when(s < 5400, F.format_string("~%.0f minutes", s / 60)).otherwise(F.format_string("~%.1f hours", s / 3600))


def figure_links(text: Column, names: Column) -> Column:
    """The k-th image token becomes a link to the k-th name; tokens beyond the names go."""
    parts = F.split(text, P.IMAGE_TOKEN, -1)
    shown = F.transform(parts, lambda p, i: F.when((i > 0) & (i <= F.size(names)) & (F.coalesce(F.get(names, i - 1), F.lit("")) != ""), F.concat(F.lit("![]("), F.get(names, i - 1), F.lit(")"), p)).otherwise(p))
    return F.array_join(shown, "")


def edge_error(body: Column) -> Column:
    """The code of a refusal by a network edge; null if it is the provider's own error."""
    code = F.regexp_extract(body, r"\A\s*error code:\s*(\d{3,4})\s*\z", 1)
    return F.when(code != "", code)


def retired_model(status: Column, body: Column) -> Column:
    return status.isin(400, 404) & body.rlike("model_not_found|model_decommissioned|does not exist")


def backoff(attempt: Column, retry_after: Column) -> Column:
    """Seconds to wait: what the server said (300 at most), else powers of two (120 at most)."""
    said = retry_after.try_cast("double")
    return F.when(said.isNotNull(), F.least(said, F.lit(300.0))).otherwise(F.least(F.pow(F.lit(2.0), attempt), F.lit(120.0)))


def parallel_pages(vram_gb: Column) -> Column:
    return F.when(vram_gb >= 40, 8).when(vram_gb >= 20, 6).when(vram_gb >= 14, 4).when(vram_gb >= 8, 2).otherwise(1)
