"""Patterns, word lists and limits that results depend on."""

# White space as Unicode has it, written out so that every regex engine agrees.
SPACE = r"[\s\x0b\x1c-\x1f\x85\p{Z}]"
NOT_SPACE = r"[^\s\x0b\x1c-\x1f\x85\p{Z}]"
TERM = "[a-z0-9]+"
CONTENT_TOKEN = r"[a-z][a-z0-9\-']+"

TARGET_TOKENS, OVERLAP_TOKENS, TABLE_TOKENS, CONTEXT_TOKENS = 512, 64, 1800, 2048
CANDIDATES, RRF_K, ROUTED_WEIGHT, TOP_K = 60, 60, 2.5, 5
BM25_K1, BM25_B = 1.5, 0.75
RERANK_POOL, RERANK_KEEP = 20, 12
UNREACHABLE = 5
MIN_PAGE_WORDS, MIN_DOCUMENT_WORDS = 10, 200
PROMPT_BUDGET, CHUNK_OVERHEAD, MAX_PER_SOURCE = 6000, 40, 3
RELEVANCE_FLOOR, SUPPORT_GATE, SUPPORT_WORDS = 0.50, 0.30, 12
HISTORY_TURNS, HISTORY_CHARS, TURN_CHARS, CONTENT_CHARS = 12, 1200, 400, 1500
FAILURE_WINDOW, FAILURE_RATE, CRAWL_FAILURE_RATE, CRAWL_MIN_ATTEMPTS = 200, 0.05, 0.15, 20
DOCUMENT_EXTENSIONS = r"(?i)\.(pdf|doc|docx|xlsx)$"

JUNK_URL = r"(?i)/(?:portfolio|blog|gallery)-|/(?:shop|cart|checkout|my-account|woocommerce-page|coming-soon|maintenance|demo|try-page|testimonials|sample-page)/?$"
PERSON_INTENT = r"(?i)\b(who|whose|dean|head of|chairman|chairperson|professor|teaches|taught|supervisor|advisor|adviser|faculty member|staff)\b"
CURRENCY_WORDS = r"(?i)\b(current|currently|latest|now|nowadays|this year|these days|up to date|up-to-date|present|today)\b"
SOURCE_CHALLENGE = (
    r"(?i)(that'?s|thats|it'?s|its|they'?re|sources?|prospectus|document|page|info\w*).{0,40}\b(from\s+20\d{2}|20\d{2}|old|outdated|out of date|stale|not current|no longer)\b"
    r"|^\s*(but|however|isn'?t|aren'?t|wasn'?t)\b.{0,60}\b(20\d{2}|old|outdated)\b"
)
YEAR_RANGE, YEAR, UPLOAD_PATH = r"(20\d{2})\s*[-–]\s*(\d{2,4})", r"(20\d{2})", r"/uploads/(20\d{2})/(\d{2})/"
TITLED_NAME = r"\b(?:Dr|Prof|Professor|Mr|Ms|Mrs|Engr)\.?\s+([A-Z][A-Za-z.\-']+(?:\s+[A-Z][A-Za-z.\-']+){0,3})"
FIGURE = r"(?<![\w.])(?:\d{1,3}(?:,\d{3})+|\d{4,})(?!\w)"
NAME_NOISE = ("phd", "prof", "professor", "dr", "mr", "ms", "mrs", "engr", "the", "and", "from", "of", "at", "is")
PAST_TERM = r"(?i)((?:19|20)\d{2})\s*(?:[-–]|to|until|through)\s*(?:[A-Za-z]+\s+)?((?:19|20)\d{2})"
ROLE_WORDS = ("dean", "head", "chair", "director", "rector", "president", "coordinator", "in charge", "incharge")
HEADER_LINE = r"(?i)^[\s\-*#>`]*\**\s*(ANSWERED|SOURCES_USED)\s*:?\**\s*(.*?)\s*$"
SEPARATOR_LINE = r"^[\s*]*-{2,}[\s*]*$"
PERIOD_WORDS = ("semester", "annual", "per year")
PERIOD_MARKERS = ("per semester", "semester fee", "annual", "per year", "each semester")
PERIODIC_FIGURE = r"\d{2,3},\d{3}"
# Words too common to tell where an answer came from.
STOPWORDS = tuple(
    """the a an and or of to in for on with is are was were be been by as at from that this these those it its he she
    they them their there here which who whom whose what when where why how can could should would may might will shall
    must do does did doing done has have had having not no nor but if then than so such also into about over under you
    your yours we our ours my mine while during before after above below between each other any all some most more less
    very much many few both either neither per via within without across upon""".split()
)
