"""Patterns of the structural rules, in Java's dialect and in RE2's for the oracles."""

# Abbreviations after which a full stop doesn't end a sentence.
ABBREVIATIONS = (
    "Mr Mrs Ms Dr Prof Sr Jr Rev Gen Col Maj Sgt Cpl Lt Cmdr Adm "
    "Gov Sen Rep St Ave Blvd Dept est approx vol no pp fig "
    "Jan Feb Mar Apr Jun Jul Aug Sep Oct Nov Dec "
    "Inc Ltd Corp Bros Co vs etc al ibid op cit"
).lower().split()

WS = r"[\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"  # what Python calls white space
WORD_CHAR = r"[\p{L}\p{N}_]"
WORD = rf"(?<!{WORD_CHAR})[a-zA-Z0-9]++(?!{WORD_CHAR})"
# all characters of WS, for trimming
WHITE_SPACE = "".join(c for k in range(0x3001) if (c := chr(k)).isspace())
# the end of a sentence: a mark that closes no abbreviation, white space, then a capital or an opening quote
_CLOSES = rf"[.!?](?<!(?<!{WORD_CHAR})(?i:{'|'.join(ABBREVIATIONS)})\.)"
BOUNDARY = rf'{_CLOSES}{WS}++(?=[A-Z"‘“])'
SENTENCE = rf'(?<={_CLOSES}){WS}++(?=[A-Z"‘“])'
ABBREVIATION_RE2 = rf"(^|[^\p{{L}}\p{{N}}_])((?i:{'|'.join(ABBREVIATIONS)}))\."
SENTENCE_RE2 = r'([.!?])[\s\p{Z}\x0b\x1c-\x1f]+([A-Z"‘“])'
CLAUSE = "[,;:]|—|–|--"
KEPT_STOP = "<!P!>"

# Numerals and ordinals that follow a heading word.
_ONE_TO_TEN = "ONE|TWO|THREE|FOUR|FIVE|SIX|SEVEN|EIGHT|NINE|TEN"
_FIRST_TO_TENTH = "FIRST|SECOND|THIRD|FOURTH|FIFTH|SIXTH|SEVENTH|EIGHTH|NINTH|TENTH"
_MORE = "ELEVEN|TWELVE|THIRTEEN|FOURTEEN|FIFTEEN|TWENTIETH|THIRTIETH|FORTIETH|FIFTIETH"


def _marker(words: str, numbers: str, rest: int) -> str:
    return rf"^(?:{words})\s+(?:[IVXLC]{{1,8}}|[0-9]{{1,3}}|{numbers})(?:[ \t]*[:—\-]?[ \t]*.{{0,{rest}}})?$"


# Structural line patterns.
PART = _marker("PART|VOLUME|SECTION|BOOK", f"{_ONE_TO_TEN}|{_FIRST_TO_TENTH}", 60)
CHAPTER = _marker(r"CHAPTER|CHAP\.?|CH\.?", f"{_ONE_TO_TEN}|{_MORE}|{_FIRST_TO_TENTH}", 80)
NUMERAL = r"^(?:[IVXLC]{1,6}|[0-9]{1,3})\.\s*$"
CAPS_TITLE = r"""^[A-Z][A-Z \t''"—\-]{3,60}$"""
KEYWORDS = "CHAPTER|PART|VOLUME|SECTION|PREFACE|INTRODUCTION|APPENDIX|CONTENTS|INDEX|EPILOGUE|PROLOGUE|FOREWORD|AFTERWORD|BOOK"
VERSE = r"^\d+:\d+\s"
START_MARK = r"^[ \t]*\*{3}[ \t]*START OF (?:(?:THE|THIS)[ \t]+)?PROJECT GUTENBERG[^*]{0,300}\*{3}[ \t]*$"
END_MARK = r"^[ \t]*(?:\*{3}[ \t]*END OF (?:(?:THE|THIS)[ \t]+)?PROJECT GUTENBERG[^*]{0,300}\*{3}|End of (?:the )?Project Gutenberg(?:'s)? (?:EBook|Etext)[^\n]*)[ \t]*$"
BARE_URL = r"""https?://[^\s\x1c-\x1f<>()\[\]"']+"""
LIST_MARKER = r"^(\s*)(?:[-*+•‣◦▪–]|\d{1,3}[.)]|[a-z][.)])\s+"
FIGURE_CAPTION = r"^(?:Figure|Fig\.)\s*\d+"
NUMBERED_HEADING = r"^(\d{1,3}(?:\.\d{1,3}){0,5})\.?\s+([A-Z][^\n]*)$"
PLAIN_TEXT = {"setext": r"^\s*(=+|-+)\s*$", "quote": r"^\s*>\s?", "note": r"^\[\^[^\]]+\]:\s*", "item": LIST_MARKER, "numbered": NUMBERED_HEADING}
PAGE_NUMBER = r"(?i)^\s*(?:page\s+)?\d{1,4}(?:\s*(?:/|of)\s*\d{1,4})?\s*$"
SENTENCE_CLOSED = r"""[.!?:"”)]$"""
REFERENCES_HEADING = r"^\W*(?:\d+(?:\.\d+)*\.?\s*)?(?:references|bibliography|works\s+cited|sources|literature\s+cited)\W*$"
NOTES_HEADING = r"^\W*(?:\d+(?:\.\d+)*\.?\s*)?(?:notes|footnotes|endnotes)\W*$"
SCRIPTURE_BOOKS = (
    r"Genesis|Exodus|Leviticus|Numbers|Deuteronomy|Joshua|Judges|Ruth|(?:First|Second|Third|Fourth)?\s*(?:Samuel|Kings|Chronicles)|Ezra|"
    r"Nehemiah|Esther|Job|Psalms?|Proverbs|Ecclesiastes|Song of Solomon|Isaiah|Jeremiah|Lamentations|Ezekiel|Daniel|Hosea|Joel|Amos|Obadiah|"
    r"Jonah|Micah|Nahum|Habakkuk|Zephaniah|Haggai|Zechariah|Malachi|Matthew|Mark|Luke|John|Acts|Romans|(?:First|Second)?\s*Corinthians|"
    r"Galatians|Ephesians|Philippians|Colossians|(?:First|Second)?\s*Thessalonians|(?:First|Second)?\s*Timothy|Titus|Philemon|Hebrews|James|"
    r"(?:First|Second|Third)?\s*(?:Peter|John)|Jude|Revelation"
)
SCRIPTURE_BOOK = (
    rf"(?:\A|(?<=\n\n))(?:(?:{SCRIPTURE_BOOKS})|BOOK\s+(?:OF\s+)?[A-Z][A-Z\s]+|"
    rf"The\s(?=[^\n]*(?<!{WORD_CHAR})(?:{SCRIPTURE_BOOKS})(?!{WORD_CHAR}))[^\n]{{0,69}}[^\s.!?])[ \t]*(?=\n\n|\n?\z)"
)
VERSE_MARK = rf"(?:^|(?<={WS}))(\d{{1,3}}):(\d{{1,3}}){WS}"

# HTML elements and attributes by what they do to blocks.
HTML_SKIP = frozenset("script style template noscript head svg math iframe".split())
HTML_LINES = frozenset("p h1 h2 h3 h4 h5 h6 dt dd summary address".split())
HTML_EDGES = frozenset("div section article main aside header footer nav body html form fieldset details dl hr center figcaption".split())
HTML_VOID = frozenset("img br hr input meta link source wbr area col".split())
HTML_BLOCKS = {"ul": "list", "ol": "list", "li": "list_item", "table": "table", "figure": "figure", "pre": "code_block", "blockquote": "blockquote"}
HTML_FOOTNOTE_ROLES = frozenset({"doc-footnote", "doc-endnote"})
HTML_FOOTNOTE_CLASSES = frozenset({"footnote", "endnote"})
HTML_FOOTNOTE_ID_TAGS = frozenset("li div aside p section".split())
HTML_FOOTNOTE_ID = r"(?:fn|footnote|endnote)[-_:]?\w"
HTML_REFERENCE_ROLE = "doc-biblioentry"

# Line and inline patterns of Markdown, and what is left of an inline in the visible text.
MARKDOWN = {
    "fence": r"^\s{0,3}(`{3,}|~{3,})",
    "atx": r"^\s{0,3}(#{1,6})(?:[ \t]+(.*?))?(?:[ \t]+#+)?[ \t]*$",
    "setext": r"^\s{0,3}(=+|-+)[ \t]*$",
    "rule": r"^\s{0,3}([-*_])(?:[ \t]*\1){2,}[ \t]*$",
    "quote": r"^\s{0,3}> ?",
    "note": r"^\s{0,3}\[\^[^\]]+\]:[ \t]*(.*)$",
    "link_definition": r"^\s{0,3}\[[^\]^][^\]]*\]:\s*\S+",
    "table_rule": r"^\s*\|?\s*:?-+:?\s*(?:\|\s*:?-+:?\s*)*\|?\s*$",
    "item": r"^(\s*)([-*+]|\d{1,9}[.)])(?:[ \t]+(.*))?$",
    "image_line": r"^\s*!\[[^\]]*\]\([^)]*\)\s*$",
    "indented": r"^(?: {4}|\t)",
    "image": r"!\[([^\]]*)\]\([^)]*\)",
    "inline_link": r"(?<!!)\[([^\]]*)\]\([^)]*\)",
    "reference_link": r"(?<!!)\[([^\]]+)\]\[[^\]]*\]",
    "autolink": r"<[a-zA-Z][a-zA-Z0-9+.-]{1,31}:[^\s<>]*>",
    "footnote_mark": r"\[\^[^\]]+\]",
}
MARKDOWN_SHOWS = [("image", " "), ("inline_link", r"\1"), ("reference_link", r"\1"), ("autolink", " "), ("footnote_mark", "")]

# A line of a table of contents, its page number, its number as a heading, and the label of the page.
CONTENTS_ENTRY = r"""(?:(?:CHAPTER|CHAP\.?|PART|BOOK|SECTION|VOLUME)\s+\S+[^\n]*|[^\n]+(?:\.{2,}|\s{2,})\s*\d+|[IVXLC\d]+\.?(?:\s+[^\n]+)?|[A-Z][A-Z '"—-]{3,80})"""
CONTENTS_PAGE = r"(?:\.{2,}|\s{2,})\s*\d+\z"
CONTENTS_NUMBER = r"(?:chapter|chap\.?|part|book|section|volume)\s+"
CONTENTS_LABEL = r"(?:TABLE OF )?CONTENTS[.:]?"

# The five schemas, their descriptions and hierarchies.
SCHEMAS = [
    ("canonical_scripture", "Scripture / Canon — Book → Chapter → Verse", ["book", "chapter", "verse"]),
    ("sectioned_book", "Sectioned Book — Part/Volume/Section → Chapter → Paragraph", ["part", "chapter", "paragraph"]),
    ("standard_book", "Standard Book — Chapter → Paragraph", ["chapter", "paragraph"]),
    ("essay_or_story_collection", "Essay / Story Collection — Essay → Paragraph", ["essay", "paragraph"]),
    ("flat", "Flat — Paragraph stream only", ["paragraph"]),
]

# Document formats by content type and by extension.
CONTENT_TYPES = {
    "text/html": "html",
    "application/xhtml+xml": "html",
    "text/markdown": "markdown",
    "text/x-markdown": "markdown",
    "application/pdf": "pdf",
    "text/plain": "text",
}
EXTENSIONS = {
    ".html": "html",
    ".htm": "html",
    ".xhtml": "html",
    ".md": "markdown",
    ".markdown": "markdown",
    ".pdf": "pdf",
    ".txt": "text",
    ".text": "text",
}
CANONICAL_TYPES = {"html": "text/html", "markdown": "text/markdown", "pdf": "application/pdf", "text": "text/plain"}
GENERIC_TYPES = ["", "application/octet-stream", "binary/octet-stream"]
