"""Patterns and limits that decide results.

Fixed values: what they recognise is given by the document format. Patterns named
with a trailing J are for Spark (Java), the others for Python; ``(?d)`` makes a
Java line end at a newline only, as in Python.
"""

from __future__ import annotations

# -- fixed values: marks between pages ---------------------------------------
PAGE_MARK_J = r"(?md)^(?:\{(\d+)\}-{10,}|<!--\s*page\s+(\d+)\s*-->)\s*$"
PAGE_ANCHOR_J = r"(?md)^<!--\s*page\s+(\d+)\s*-->\s*$"
DASHES = 48
IMAGE_TOKEN = "<!--figure-->"

# -- fixed values: white space as Python's str.strip sees it ------------------
BLANK_J = r"[\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"

# -- fixed values: running heads ---------------------------------------------
HEAD_LENGTH, HEAD_SHARE, HEAD_EDGE, HEAD_PAGES, HEAD_RUN, HEAD_GAP = 60, 0.30, 2, 4, 3, 2
STRUCTURE_J = r"^(?:[-*+]\s|\d+[.)]\s|>|\||```|~~~|\$\$|<)"

# -- fixed values: marginal page numbers -------------------------------------
MARGIN_J = r"^\s*\**(\d{1,3})\**\s*$"
MARGIN_MOST = 437

# -- fixed values: characters ------------------------------------------------
LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st"}
SOFT_BREAK_J = r"\u00ad[ \t]*\n[ \t]*"
INVISIBLE_J = r"[\u00ad\u200b\u2060\ufeff\x00-\x08\x0b\x0c\x0e-\x1f\x7f]"

# -- fixed values: words and hyphens -----------------------------------------
HYPHENS = "-\u2010\u2011"
TOKEN_J = rf"[\p{{L}}\p{{N}}]+(?:[{HYPHENS}][\p{{L}}\p{{N}}]+)*"
#: TOKEN_J as a whole, from where it starts: no other start or end can match more, and none is tried.
WHOLE_J = rf"(?<![\p{{L}}\p{{N}}])[\p{{L}}\p{{N}}]++(?:[{HYPHENS}][\p{{L}}\p{{N}}]++)*+"
BREAK_J = rf"({WHOLE_J})([{HYPHENS}])[ \t]*\n[ \t]*({WHOLE_J})"
TOKEN = rf"[^\W_]+(?:[{HYPHENS}][^\W_]+)*"
BREAK = rf"({TOKEN})([{HYPHENS}])[ \t]*\n[ \t]*({TOKEN})"
VOCABULARY_J = rf"[\p{{L}}\p{{Nl}}\p{{No}}]+(?:[{HYPHENS}][\p{{L}}\p{{Nl}}\p{{No}}]+)*"

# -- fixed values: structure of Markdown lines -------------------------------
INLINE = r"(?:sup|sub|i|b|em|strong|a|span|math)\b"
BLOCK = rf"(?:#{{1,6}}\s|[-*+]\s|\d+[.)]\s|>|\||!\[|\[\^[^\]]+\]:|<(?!/?{INLINE}))"
BLOCK_LINE = rf"(?:#{{1,6}}\s|\||!\[|```|~~~|\$\$|<(?!/?{INLINE}))"
HEADING_J = r"^(#{1,6})[ \t]+(.*\S)[ \t]*$"
RUN_IN_J = r"^\*\*([^*\n]{2,120})\*\*[ \t]+(\S.*)$"
LABEL = r"(\*\*|__)[^*_\n]{1,60}\1"
HYPHEN_END = rf"\w[{HYPHENS}]$"

# -- fixed values: notes and links -------------------------------------------
NOTE_ID = "[0-9ivxIVX]{1,4}"
NOTE = rf"(?:<sup>{NOTE_ID}</sup>|\[\^{NOTE_ID}\])"
NOTE_PARAGRAPH = rf"(?:\[\^[^\]]+\]:|<sup>{NOTE_ID}</sup>)"
SENTENCE_TAIL = "(?:\\[\\^[^\\]]+\\]|<sup>[^<]*</sup>|[\\s*_\"'”’»)\\]])+$"
LINK = r"(?<!!)\[([^\]\n]*)\]\(#([^)\s]+)\)"
CITED_J = r"(?:\\?[\p{L}\p{Nl}\p{No}]|\\?[),;])?\d[\d–-]*(?:\\?\)|[.,;:])?"
LINK_SPACE_J = r"(\]\(#[^)\s]+\))[ \t]+(?=[,.;:](?:\s|\z))"
TARGET_J = "id=[\"']([^\"']+)[\"']"
CHUNK_TARGET_J = "(\\(#|id=[\"'])(page-\\d+-\\d+)"
IMAGE_J = r"!\[[^\]]*\]\(([^)]+)\)"
IMAGE_LINK = r"(!\[[^\]]*\]\()([^)\s]+)((?:\s+[^)]*)?\))"

# -- fixed values: outline ---------------------------------------------------
OUTLINE_SLACK, OUTLINE_PREFIX = 1, 12

# -- fixed values: audit -----------------------------------------------------
MARKUP_J = r"(?s)<!--.*?-->|!?\[[^\]]*\]\([^)]*\)|\[\^[^\]]+\]:?|<[^>]+>"
UNIT_J = r"(?<=[.!?])\s+|\n+"
WITNESS, SHORT, LONG, INK, EMPTY = 200, (3, 5), (8, 5), 0.01, 20
SPARSE, SPARSE_PAGES = 0.25, 8
LOOP_TIMES, LOOP_SHARE, LOOP_LETTERS = 4, (3, 10), 12

# -- fixed values: checks ----------------------------------------------------
RUN_ON_J = "[A-Za-z']{28,}"
RUN_ONS = 5
GREEK_J = r"[\u0370-\u03ff\u1f00-\u1fff]+"
ITALIC_J = r"(?<!\*)\*(?!\*)[^*\n]+\*(?!\*)"
FOOTNOTE_J = r"\[\^[^\]]+\]|<sup>"
STALE = ["itse1f", "sorne", "certainwayof", "whichisDasein", "cornpletely", "sirnply"]
SIMILAR, SIMILAR_PAGES, SIMILAR_TEXT, SIMILAR_MOST = 0.90, 8, 200, 20_000

# -- fixed values: analysis and spreads --------------------------------------
PRODUCER_J = r"(?i)paper\s*capture|abbyy|finereader|tesseract|scansoft|omnipage|readiris|ocr|luradocument|luratech|djvu|scanned"
COVERED, SCANNED, FEW_CHARS, RUN_ONS_1K, OCR_SECONDS, TEXT_SECONDS = 0.9, 0.6, 120, 1.0, 45.0, 0.2
SEARCH = (0.35, 0.65)
BLANK_COLUMN, FOLD, BLANK_HALF, BAND, SPREADS = 0.05, 0.01, 0.02, 0.015, 0.6

# -- fixed values: chapters --------------------------------------------------
SECTION, CHAPTER_MOST, PIECE_LEAST, BOOK_PAGES, PAGE_CHARS, LEVELS, TITLE_MOST = 20_000, 200_000, 500, 60, 2_000, 3, 80
FRONT = "Front matter"
FENCE_J = r"^\s*(```|~~~)"
SPLITLINES_J = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"
DEFINITION = r"\[\^([^\]\s]+)\]:"
REFERENCE = r"\[\^([^\]\s]+)\](?!:)"

# -- fixed values: chunks, translation, catalog, watching --------------------
CHUNK_PAGES, QUEUE_CHUNK_PAGES, TRANSLATE_PAGES, MOST_TOKENS, ATTEMPTS = 20, 10, 10, 8000, 3
STALL_SECONDS = 1200
FREE_GB, START_GB, PREFLIGHT_GB = 2.0, 3.5, 4.0
