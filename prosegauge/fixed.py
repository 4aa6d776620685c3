"""Word lists, patterns, limits and names.

Everything here must be exactly so for results to be right; nothing here is
logic.  The column builders and the SQL oracles both read these values, so
hand-computed expectations in the tests guard against a wrong constant.
"""

from __future__ import annotations

# ---- characters ---------------------------------------------------------------

#: White space: what Unicode-aware regular expressions call ``\s``.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
#: The same as the inside of a character class (Java and RE2 syntax).
WS = r"\t\n\x{0B}\f\r\x{1C}\x{1D}\x{1E}\x{1F}\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
#: Line ends other than the line feed.
OTHER_LINE_ENDS = r"\x{0B}\f\r\x{1C}-\x{1E}\x{85}\x{2028}\x{2029}"
#: Inside of a class: letters and digits of any script, and the underscore.
WORD_CHARS = r"\p{L}\p{N}_"
#: Inside of a class: word characters that are neither decimal digits nor the underscore.
LETTER_CHARS = r"\p{L}\p{Nl}\p{No}"

# ---- tokens -------------------------------------------------------------------

#: Chunks that are no words.
IGNORED_MARKERS = ("•", "\uf0b7", "◦", "◻", "☐", "☑", "□")
#: Chunks whose last dot is never removed.
TOKEN_ABBREVIATIONS = ("Dr.", "Mr.", "Mrs.", "Ms.", "U.S.", "U.S.C.", "e.g.", "i.e.", "p.m.", "a.m.")
#: A chunk is split at these (and at ``://``, which the stripping of ``:`` covers).
TOKEN_DELIMITERS = "/\\–—"
OPENERS = "\"“‘([{"
CLOSERS = "\"”’)]}"
TRAILERS = "\"”’)]},;:"
#: Stripped at both ends before a token's syllables are counted.
SYLLABLE_STRIPPED = "\"“”‘’()[]{}.,;:!?"
#: Syllables of whole words that the estimate gets wrong, by case-folded word.
SYLLABLE_EXCEPTIONS = {"aaliyah": 3, "schedule": 2, "uei": 2, "résumé": 3}
NUMERIC = r"(\$)?(\p{Nd}[\p{Nd},]*(?:\.\p{Nd}+)?)(%)?"

# ---- sentences ----------------------------------------------------------------

#: Protected in this order, whatever their case, and then written as here.
SENTENCE_ABBREVIATIONS = ("e.g.", "i.e.", "etc.", "U.S.", "No.", "Mr.", "Ms.", "Dr.", "Inc.", "vs.", "a.m.", "p.m.")
SENTENCE_CLOSERS = "\"'’”)"

# ---- first-generation method set ----------------------------------------------

V1_WORD = "[A-Za-z]+(?:['’-][A-Za-z]+)*"
V1_LIST_MARKS = "•●▪◻☐☑□*-"
V1_ABBREVIATIONS = ("e.g.", "i.e.", "etc.", "U.S.", "No.", "Mr.", "Ms.", "Dr.", "Inc.", "vs.")

# ---- passive sentences --------------------------------------------------------

BE_FORMS = ("am", "are", "be", "been", "being", "is", "was", "were")
GET_FORMS = ("get", "gets", "getting", "got", "gotten")
#: From the second version on.
CONTRACTED_BE = ("aren't", "isn't", "wasn't", "weren't", "you're", "we're", "they're", "i'm")
#: Words that may stand between; ``indeed`` from the second version on.
INTERVENING = (
    "also", "already", "always", "being", "been", "currently", "directly", "duly", "ever", "expressly",
    "fully", "generally", "in", "indirectly", "never", "no", "not", "now", "only", "otherwise",
    "partially", "properly", "regularly", "separately", "specifically", "still", "then", "typically",
    "usually", "well", "yet",
)
IRREGULAR_PARTICIPLES = (
    "arisen", "awoken", "begun", "bent", "bound", "broken", "brought", "built", "bought", "caught",
    "chosen", "come", "cost", "cut", "dealt", "done", "drawn", "driven", "eaten", "fallen", "fed",
    "felt", "fled", "flown", "forbidden", "forgotten", "forgiven", "found", "frozen", "given", "gone",
    "grown", "had", "heard", "held", "hidden", "hit", "hurt", "kept", "known", "laid", "led", "left",
    "lent", "let", "lost", "made", "meant", "met", "paid", "put", "read", "ridden", "risen", "run",
    "said", "seen", "sent", "set", "shown", "shut", "sold", "sought", "spent", "split", "spoken",
    "stolen", "stuck", "sung", "sunk", "sworn", "swept", "swum", "taken", "taught", "told", "thought",
    "thrown", "understood", "woken", "won", "worn", "written",
)
#: No participles, from the second version on.
NO_PARTICIPLES = ("need", "indeed")
STATE_ADJECTIVES = ("underinsured", "uninsured", "unrestricted")
#: A participle followed by one of these words describes a state.
STATE_COMPLEMENTS = {
    "associated": ("with",),
    "interested": ("in",),
    "involved": ("in", "with"),
    "positioned": ("to",),
    "prepared": ("to",),
}
GET_RESULTS = ("started",)
#: ``as defined by`` is no passive, from the third version on.
AS_BY_EXCLUDED = ("defined",)
PASSIVE_RULES = ("be_auxiliary_plus_participle", "get_auxiliary_plus_participle", "as_participle_plus_by", "no_bounded_passive")
FINITE_REACH, AS_BY_REACH, THERE_REACH = 5, 4, 2

# ---- structure ----------------------------------------------------------------

ROLES = (
    "body", "heading", "table", "list", "cover", "table_of_contents", "instruction", "header", "footer",
    "navigation", "decorative", "unknown",
)
BOUNDARIES = ("none", "line", "paragraph", "page")
CONFIDENCES = ("high", "medium", "low", "unknown")
UNKNOWN_POLICIES = ("warn_and_include", "warn_and_exclude", "unable_to_calculate")
METRICS = (
    "word_count", "words_per_sentence", "characters_per_word", "flesch_reading_ease",
    "flesch_kincaid_grade_level", "passive_sentence_percentage",
)
UNITS = ("words", "words_per_sentence", "characters_per_word", "score", "grade_level", "percent")
METHOD_SLOTS = (
    "tokenizer", "sentence_segmenter", "character_counter", "syllable_counter", "readability_formula",
    "passive_classifier",
)
#: Method slot of each metric, in the order of METRICS.
SLOT_OF_METRIC = (
    "tokenizer", "sentence_segmenter", "character_counter", "readability_formula", "readability_formula",
    "passive_classifier",
)
CAPABILITIES = (
    "text", "page_geometry", "pdf_structure", "logical_roles", "reading_order", "page_mapping",
    "sidecar_alignment",
)
OBSERVED_PDF_METADATA = ("Creator", "Producer")

UNKNOWN_ROLE_REASON = "Profile cannot calculate this metric with unknown-role segments."
NO_DENOMINATOR_REASON = "The semantic sentence scope has no usable denominator."

# ---- lines of a page ----------------------------------------------------------

LINE_LIST_MARKS = "•●▪◦◻☐☑□*-"
EDGE_MIN_CHARS, EDGE_MAX_CHARS = 3, 180
EDGE_MIN_PAGES, EDGE_PAGE_SHARE = 3, 0.30
HEADING_MAX_WORDS, HEADING_MAX_CHARS = 10, 80
COVER_LINES = 4
#: Roles that always begin a block when lines are joined to paragraphs.
BLOCK_START_ROLES = (
    "heading", "table", "cover", "table_of_contents", "instruction", "header", "footer", "navigation",
    "decorative",
)
DEFAULT_LINE_HEIGHT = 11.0
SHIFT_LIMIT, LIST_SHIFT_LIMIT = 14.0, 24.0
OVERLAP_SHARE, GAP_SHARE, GAP_POINTS = 0.35, 0.8, 8.0

# ---- tagged pages -------------------------------------------------------------

ROLE_OF_TAG = {
    "P": "body", "H": "heading", "H1": "heading", "H2": "heading", "H3": "heading", "H4": "heading",
    "H5": "heading", "H6": "heading", "H7": "heading", "Lbl": "heading", "LBody": "list", "TH": "table",
    "TD": "table", "Caption": "heading", "Note": "body", "TOCI": "table_of_contents",
}
CONTAINER_TAGS = ("Lbl", "LBody", "TH", "TD", "Caption", "Note", "TOCI")
CELL_TAGS = ("TD", "TH")
CELL_BLOCK_TAGS = ("P", "H", "H1", "H2", "H3", "H4", "H5", "H6", "H7")
CONTINUED_TAGS = ("P", "LBody", "TD")
PANEL_MIN_WIDTH, PANEL_MIN_HEIGHT, PANEL_MIN_LEFT, PANEL_EDGE = 0.12, 24.0, 0.70, 1.0
PANEL_TOLERANCE = 2.0
TOP_BAND, TWIN_TOLERANCE, TWIN_PAGES = 36.0, 2.0, 2
LINK_TOLERANCE = 1.0
LINE_TOLERANCE, LINE_LOOKBACK = 3.0, 4

# ---- markup -------------------------------------------------------------------

VOID_TAGS = frozenset({"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"})
SKIPPED_TAGS = frozenset({"noscript", "script", "style", "svg", "template"})
BLOCK_TAGS = frozenset(
    {
        "address", "article", "aside", "blockquote", "caption", "dd", "details", "dialog", "div", "dl", "dt", "fieldset", "figcaption", "figure",
        "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "h7", "header", "hr", "legend", "li", "main", "nav", "ol", "p", "pre", "section",
        "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul"
    }
)
HEADING_TAGS = frozenset({"caption", "dt", "h1", "h2", "h3", "h4", "h5", "h6", "h7", "legend", "summary", "th"})
TEXT_BLOCK_TAGS = frozenset({"blockquote", "dd", "figcaption", "p", "pre"})
#: Start tags that end an open paragraph.
ENDS_PARAGRAPH = frozenset(
    {
        "address", "article", "aside", "blockquote", "div", "dl", "fieldset", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr",
        "main", "nav", "ol", "p", "pre", "section", "table", "ul"
    }
)
#: Start tags that end an open element of their family: the family, and what shields it.
ENDS_FAMILY = {
    "li": (frozenset({"li"}), frozenset({"menu", "ol", "ul"})),
    "dt": (frozenset({"dd", "dt"}), frozenset({"dl"})),
    "dd": (frozenset({"dd", "dt"}), frozenset({"dl"})),
    "tr": (frozenset({"tr"}), frozenset({"table"})),
    "td": (frozenset({"td", "th"}), frozenset({"table", "tr"})),
    "th": (frozenset({"td", "th"}), frozenset({"table", "tr"})),
    "thead": (frozenset({"tbody", "tfoot", "thead"}), frozenset({"table"})),
    "tbody": (frozenset({"tbody", "tfoot", "thead"}), frozenset({"table"})),
    "tfoot": (frozenset({"tbody", "tfoot", "thead"}), frozenset({"table"})),
    "option": (frozenset({"option"}), frozenset({"datalist", "optgroup", "select"})),
    "optgroup": (frozenset({"optgroup"}), frozenset({"datalist", "select"})),
}
EMPTY_INLINE_TAGS = frozenset({"hr", "img", "input"})
STICKY_ROLES = frozenset({"footer", "header", "navigation"})

# ---- word-processor structure -------------------------------------------------

WORD_NAMESPACE = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
WORD_ROLES = ("cover", "cover_position", "table_of_contents", "instruction", "metadata")
WORD_BASES = ("gallery", "style", "field", "label", "table", "builder", "section")
MARKABLE_TAGS = frozenset({"h1", "h2", "h3", "h4", "h5", "h6", "li", "p"})
WORD_MARKER = "scope_[0-9a-f]{16}_[0-9]+"
COVER_MAX_WORDS, COVER_MAX_PARAGRAPH_WORDS = 100, 25
METADATA_HEADINGS = ("basic information", "before you begin")
INSTRUCTION_LABEL = r"(?i)^(?:instructions for (?:nofo writers|template managers|new nofo team)\b|[^\n]+?-specific instructions\b)"

# ---- reliability of estimates --------------------------------------------------

#: By metric, in the order of METRICS.
HIGH_DELTAS = (0.5, 0.5, 0.5, 1.0, 0.2, 0.5)
MODERATE_DELTAS = (2.0, 2.0, 2.0, 3.0, 0.5, 2.0)
ABSOLUTE_DELTA_METRICS = ("flesch_reading_ease", "flesch_kincaid_grade_level", "passive_sentence_percentage")
HIGH_SHARE, MODERATE_SHARE = 0.005, 0.02
LEVELS = ("low", "moderate", "high")

# ---- formulas -----------------------------------------------------------------

EASE = (206.835, 1.015, 84.6)
GRADE = (0.39, 11.8, 15.59)
