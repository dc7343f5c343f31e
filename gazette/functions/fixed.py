"""Fixed values that must equal the reference's behaviour for equal results.

Stated once, plainly, in their natural order.
"""

# --- fixed values --------------------------------------------------------
# URL blocklist patterns, matched at the start of the raw link (unescaped dots).
URL_BLOCKLIST = [r".*/www.youtube.com/.*"]

# Dependency labels of a sentence subject, and of auxiliaries.
SUBJECT_DEPS = ["agent", "csubj", "csubjpass", "expl", "nsubj", "nsubjpass"]
AUX_DEPS = ["aux", "auxpass"]

# Sentence trimming (lemma prefixes, POS prefixes, lemma suffix patterns).
DROP_LEMMA_PREFIXES = [["on", "top", "of", "that", ","], ["that", "say", ","]]
DROP_POS_PREFIXES = [["ADV", "PUNCT"], ["ADV", "ADV", "PUNCT"], ["INTJ", "PUNCT"],
                     ["CCONJ", "PUNCT"], ["CCONJ"]]
DROP_LEMMA_SUFFIXES = [[",", "say"], [",", "-PRON-", "say"], [",", "-PRON-", "tell"]]

# Non-news title patterns. Each term is (field, value), field in text/lemma/pos.
TITLE_START_PATTERNS = [
    [("lemma", "the"), ("text", "best")],
    [("lemma", "save"), ("pos", "SYM")],
    [("lemma", "how"), ("lemma", "to")],
]
TITLE_ANYWHERE_PATTERNS = [
    [("lemma", "deal"), ("lemma", "of"), ("lemma", "the"), ("lemma", "day")],
    [("lemma", "deal"), ("lemma", "of"), ("lemma", "the"), ("lemma", "week")],
    [("pos", "PUNCT"), ("lemma", "how"), ("lemma", "to")],
    [("pos", "NUM"), ("lemma", "%"), ("lemma", "discount")],
]
TITLE_DEAL_LEMMA = "deal"
TITLE_DEAL_PATTERNS = [[("pos", "SYM"), ("pos", "NUM")]]

# Content-token rule: lemma must start with two ASCII letters.
CONTENT_LEMMA_PATTERN = r"^[A-Za-z]{2,}"

# Sentence score weights and length target.
FREQ_WEIGHT, SIM_WEIGHT, LEN_WEIGHT = 0.5, 0.4, 0.1
LEN_SCORE_NUMERATOR, LEN_TARGET = 0.1, 20.0

# Defaults: summary length, similarity window and threshold, retries, stale age.
DEFAULT_TOP_N = 4
SIMILARITY_WINDOW_HOURS = 12
SIMILARITY_THRESHOLD = 0.3
MAX_RETRIES = 3
STALE_AFTER_HOURS = 1
TRAIN_SAMPLE_SIZE = 15000

# Article statuses: new, queued, done, error.
STATUS_NEW, STATUS_QUEUED, STATUS_DONE, STATUS_ERROR = "N", "Q", "D", "E"

# Display and message strings and formats ({name} marks a value).
ANONYMOUS_SOURCE = "Anonymous"
MESSAGE_TEMPLATE = '<b>{title}</b>\n\n{summary}\n\n<a href="{uri}"><i>{source}</i></a>'
SUMMARY_LINE_TEMPLATE = "— {sentence}"
SUMMARY_LINE_SEPARATOR = "\n"
IMPORTANCE_ICON = "\U0001F525"
PROMOTE_BUTTON_TEMPLATE = "Promote {icons}"
PROMOTE_CALLBACK = "promote"
LOG_LINE_TEMPLATE = "<PageSaver> [{ts}] {message}"
NOT_FETCHED_TEMPLATE = "Article #{id} not been fetched yet"

# Page text: subtrees dropped by CSS selector; reader title ends at this separator.
DROP_SELECTORS = ["#engadget-article-footer", ".reader-header"]
READER_TITLE_SEPARATOR = "|"

# Canonical article URL: everything from the first match of this pattern is cut.
QUERY_FRAGMENT_PATTERN = r"[?#].*"
