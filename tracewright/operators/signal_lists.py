"""Fixed values of text attention: patterns, markers, strengths, weights and thresholds."""

#: Characters that a trimmed line does not begin or end with, as a pattern class.
SPACE = r"[\s\p{Z}\x{FEFF}]"
BLANK = rf"^{SPACE}*$"

# What is replaced in a line to get its template, in this order.
TOKENS = (
    ("<timestamp>", r"(?i)\b\d{4}-\d{2}-\d{2}[T ][0-2]\d:[0-5]\d(?::[0-5]\d(?:\.\d{1,9})?)?(?:Z|[+-]\d{2}:?\d{2})?\b"),
    ("<date>", r"\b\d{4}-\d{2}-\d{2}\b"),
    ("<time>", r"\b[0-2]\d:[0-5]\d(?::[0-5]\d(?:\.\d+)?)?\b"),
    ("<uuid>", r"(?i)\b[0-9a-f]{8}-[0-9a-f]{4}-[1-5][0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}\b"),
    ("<ipv4>", r"\b(?:\d{1,3}\.){3}\d{1,3}\b"),
    ("<email>", r"(?i)\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b"),
    ("<url>", r"(?i)\bhttps?://[^\s<>\"')\]]+"),
    ("<quoted>", r"([\"'])(?:\\.|(?!\1).)*\1"),
    ("<duration>", r"(?i)\b\d+(?:\.\d+)?\s?(?:ns|µs|us|ms|s|sec|secs|seconds?|m|min|mins|minutes?|h|hrs?|hours?)\b"),
    ("<bytes>", r"\b\d+(?:\.\d+)?\s?(?:B|KB|KiB|MB|MiB|GB|GiB|TB)\b"),
    ("<hex>", r"(?i)\b0x[0-9a-f]+\b|\b[0-9a-f]{16,}\b"),
    ("<windows-path>", r"\b[A-Za-z]:\\(?:[^\\\s:*?\"<>|]+\\)*[^\\\s:*?\"<>|]*"),
    ("<unix-path>", r"^/(?:[\w.@+-]+/)*[\w.@+-]+"),
    ("$1<path>", r"([\s=(])/(?:[\w.@+-]+/)*[\w.@+-]+"),
    ("<decimal>", r"(?<![\w.])-?\d+\.\d+(?![\w.])"),
    ("<integer>", r"(?<!\w)-?\d{2,}(?!\w)"),
)
#: Tokens that need a digit: lines without one skip them.
WITH_DIGITS = ("<timestamp>", "<date>", "<time>", "<ipv4>", "<duration>", "<bytes>", "<decimal>", "<integer>")

# Lexical features, what each speaks for and how strongly.
FEATURES = (
    ("prohibition", "constraint", 1.00, r"(?i)\b(?:must\s+not|shall\s+not|never|forbidden|cannot|prohibited)\b"),
    ("obligation", "constraint", 0.86, r"(?i)\b(?:must|shall|required|requires?)\b"),
    ("recommendation", "constraint", 0.52, r"(?i)\b(?:should|prefer(?:red)?)\b"),
    ("exception", "exception", 0.90, r"(?i)\b(?:unless|except(?:ion)?|however|may\s+override|with\s+the\s+exception)\b"),
    ("decision", "decision", 0.82, r"(?i)\b(?:we\s+chose|decision|will\s+use|selected\s+approach)\b"),
    ("definition", "definition", 0.72, r"(?i)\b(?:means|defined\s+as|refers\s+to|is\s+the\s+term\s+for)\b"),
    ("threshold", "constraint", 0.78, r"(?i)(?:<=|>=|<|>|at\s+(?:least|most)|no\s+more\s+than|fewer\s+than|within)\s*\d+(?:\.\d+)?(?:\s?(?:%|ms|s|seconds?|minutes?|hours?|B|KB|MB|GB|rows?|records?|lines?))?"),
    ("failure", "failure", 1.00, r"(?i)\b(?:fatal|failed|failure|rejected|rollback|panic|aborted)\b"),
    ("error", "failure", 0.88, r"(?i)\berrors?\b"),
    ("warning", "warning", 0.72, r"(?i)\b(?:warn(?:ing)?|deprecated|partial(?:ly)?|skipped)\b"),
    ("action", "constraint", 0.66, r"(?i)\b(?:TODO|FIXME|owner|deadline)\b"),
)
# A line like one of these has no error.
NO_ERROR = (
    r"(?i)\b(?:no|zero|without)\s+(?:new\s+)?errors?\b",
    r"(?i)\b0\s+errors?\b",
    r"(?i)\berrors?\s*(?:count\s*)?[:=]\s*0\b",
    r"(?i)\b(?:success|successful|passed|resolved|handled)\b[^.\n]{0,48}\berrors?\b",
)
# Exact evidence.
EVIDENCE = (
    ("date", r"\b\d{4}-\d{2}-\d{2}\b"),
    ("quantity", r"(?i)\b\d+(?:\.\d+)?\s?(?:%|ms|s|seconds?|minutes?|hours?|B|KB|MB|GB|rows?|records?|lines?)\b"),
    ("field", r"`[^`\n]+`|\b[a-z][a-z0-9]*(?:_[a-z0-9]+)+\b"),
    ("path", r"\b[A-Za-z]:\\[^\s]+|(?:^|\s)/(?:[\w.@+-]+/)+[\w.@+-]+"),
    ("identifier", r"(?i)\b[A-Z]{2,8}-\d+\b|\b[0-9a-f]{8}-[0-9a-f-]{27,}\b"),
)
# Words that do not count in restatements.
STOP_WORDS = ("a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "in", "is", "it", "of", "on", "or", "that", "the", "this", "to", "with")
# Lines of a stream and of a document.
STREAM = (r"(?i)^\s*(?:\d{4}-\d{2}-\d{2}[T ]|\d{2}:\d{2}:\d{2}|\[(?:trace|debug|info|warn|error|fatal)\])", r"\b(?:INFO|WARN|ERROR|FATAL|DEBUG|TRACE)\b")
DOCUMENT = (r"^\s{0,3}(?:#{1,6}\s|[-*]\s|\d+[.)]\s)", rf"[.!?]{SPACE}*$")
# Weights of the score's parts in hundredths; parts are whole ten-thousandths.
WEIGHTS = {"pattern_break": 30, "rarity": 13, "concrete": 17, "severity": 24, "novelty": 7, "local": 13, "repetition": 8, "ambiguity": -12}
ATTENTION, NOTABLE = 6200, 3600
SEVERE, SEVERE_FLOOR, PROHIBITION_FLOOR = 8500, 6800, 6600
#: Delimiters and their names; of equally frequent ones the first counts.
DELIMITERS = ((",", ","), (":", ":"), ("=", "="), ("|", "|"), ("\t", "tab"))
# Limits of a text that is looked at line by line.
MOST_BYTES, MOST_LINES, MOST_LINE_BYTES = 2 * 1024 * 1024, 20_000, 256 * 1024
