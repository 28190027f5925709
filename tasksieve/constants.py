"""Fixed values shared by the operators.

Everything in this module is data that has to hold exactly these values for
results to be right: patterns, word lists, thresholds, rule tables and output
formats.  Domain values that differ per deployment (bot names, deep-link hosts,
entity dictionaries) are parameters of the operators instead.

Patterns are written in the common subset of Java and RE2 syntax, without
inline flags; the operators add the flags they need.
"""

# ---------------------------------------------------------------- fixed values
# Character classes (Unicode aware in Java as well as RE2).
WORD = r"[\p{L}\p{N}_]"
NOT_WORD = r"[^\p{L}\p{N}_]"
BLANKS = (" \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
          "\u2028\u2029\u202f\u205f\u3000")
SPACE = r"[\s\p{Z}\x{0B}\x{1C}-\x{1F}\x{85}]"

# Structural masks, in order: (pattern, ignore case, placeholder).
EMAIL = r"[\p{L}\p{N}_.%+\-]+@[\p{L}\p{N}_.\-]+\.[a-zA-Z]{2,}"
URL = r"https?://\S+|www\.\S+"
LABELLED_ID = (
    r"(?:entity|account|owner|task|direct|id|ticket|portfolio|view)"
    r"\s*(?:id|#|:)?\s*[:=]?\s*\d{4,}"
)
LONG_NUMBER = r"\b\d{8,}\b"
PHONE = r"\(?\d{3}\)?[\s.\-]\d{3}[\s.\-]\d{4}"
STRUCTURAL_MASKS = [
    (EMAIL, False, "[EMAIL]"),
    (URL, False, "[URL]"),
    (LABELLED_ID, True, "[ID]"),
    (LONG_NUMBER, False, "[ID]"),
    (PHONE, False, "[PHONE]"),
]
# The early variant masks shorter numbers and uses looser patterns.
LOOSE_STRUCTURAL_MASKS = [
    (r"\S+@\S+\.\S+", False, "[EMAIL]"),
    (URL, False, "[URL]"),
    (r"\b\d{3}[-.\s]?\d{3}[-.\s]?\d{4}\b", False, "[PHONE]"),
    (r"\b\d{6,}\b", False, "[ENTITY_ID]"),
]

# Boilerplate, in order: (pattern, flags).  i = ignore case, s = dot matches
# newline, m = ^ and $ match at lines.
BOILERPLATE = [
    (r"[-\x{2014}\x{2015}\x{2500}]{3,}\s*\n?This task was submitted.*", "is"),
    (r"This task was submitted through[^\n]*", "i"),
    (r"https?://\S+", ""),
    (r"(?:best regards|kind regards|regards,|thank you in advance)[,.\s\n].*", "is"),
    (r"\[insert [^\]]+\]", "i"),
    (r"\*{2,}", ""),
    (r"^\s*-{4,}\s*$", "m"),
]
GREETINGS = [
    r"hi\s+team", r"hello\s+team", r"hi\s+there", r"dear\s+team",
    r"please\s+see\s+below", r"please\s+find\s+below",
    r"as\s+per\s+our\s+(?:call|discussion|conversation)",
    r"as\s+discussed", r"as\s+requested",
    r"hope\s+(?:you|this)\s+(?:are|is)\s+well",
    r"thank\s+you\s+(?:for|in\s+advance)", r"thanks\s+(?:for|in\s+advance)",
    r"kind\s+regards", r"best\s+regards", r"regards,",
    r"let\s+me\s+know\s+if\s+you\s+have\s+(?:any\s+)?questions",
    r"\*\*no\s+additional\s+information\s+provided\*\*",
    r"no\s+additional\s+information",
]
FORM_LABELS = [
    r"Name:", r"Email address:", r"How may we assist you\??:", r"Please specify\.?:",
    r"Any additional information you would like to include\??:",
    r"Please select the priority level (?:for|of) this request\.?:",
    r"Please select the issue\.?:", r"Please select the type of account\.?:",
    r"Please select the Sub Asset class:", r"Please confirm the asset class\.?:",
    r"Commitment amount\.?:", r"Commitment date\.?:", r"Name of the investment\.?:",
    r"Please specify\.?\s*:?", r"Name of the direct owner\.?:",
    r"What is the name of the financial institution\??:",
    r"Please provide more details on the data classification issue \(optional\)\.?:",
]
INTENT_LABELS = ["How may we assist you?:", "Please select the issue.:"]
DETAIL_LABEL = "Please specify.:"
NOISE_ANSWERS = ["Medium", "High", "Low", "Normal", "Urgent"]
RULE_CHARS = r"[\x{2014}\x{2015}\x{2500}\x{2501}\x{2550}]{3,}"
FORM_LABEL_LINE = r"^([A-Z][^\n:]{3,80}[?]?):"

# Name variants.
BUSINESS_SUFFIX = (
    r",?\s+(?:LLC|LLP|LP|Inc\.?|Ltd\.?|Corp\.?|Family\s+Office|Capital(?:\s+Partners)?|"
    r"Holdings?|Partners?|Advisors?|Ventures?|Investments?|Management|Group|Trust|Wealth)\b\.?"
)
BUSINESS_SUFFIX_WIDE = (
    r",?\s+(?:LLC|L\.L\.C\.?|LLP|LP|L\.P\.?|Inc\.?|Ltd\.?|Limited|Corp\.?|Corporation|P\.C\.?|PLLC|"
    r"Family\s+Office|Capital(?:\s+Partners)?|Holdings?|Partners?|Advisors?|Advisory|Ventures?|"
    r"Investments?|Investment\s+Partners?|Management|Entities|Group|Trust|Wealth|Exploration|Ranch|"
    r"Equities|International|Enterprises?)\b\.?"
)
NAME_SKIP = ["the", "and", "for", "llc", "lp", "inc", "ltd", "n/a", "na", "firm", "group", "trust"]
NAME_SKIP_WIDE = NAME_SKIP + [
    "cap", "mgmt", "co", "int", "intl", "corp", "new", "old", "all", "any", "one", "two", "three", "own",
]
HOUSEHOLD_SKIP = ["n/a", "firm-wide", "", "firm wide"]

# Entity removal.
CLEANUP_PREPOSITIONS = "in|to|from|with|at|on|for|by|of|via|into|onto|through"
FLAG_PREPOSITIONS = "in|to|from|with|at|on|for|by|of|via"

# Detectors: (type, pattern, score, placeholder).
DETECTORS = [
    ("EMAIL_ADDRESS", EMAIL, 1.0, "[EMAIL]"),
    ("PHONE_NUMBER", PHONE, 0.9, "[PHONE]"),
    ("US_SSN", r"\b\d{3}-\d{2}-\d{4}\b", 0.85, "[ID]"),
    ("CREDIT_CARD", r"\b\d{4}[ \-]?\d{4}[ \-]?\d{4}[ \-]?\d{4}\b", 1.0, "[CREDIT_CARD]"),
]
LEAKAGE_PATTERNS = [
    ("EMAIL", r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b"),
    ("PHONE", r"\b(?:\+?1[-.\s]?)?\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}\b"),
    ("SSN", r"\b\d{3}-\d{2}-\d{4}\b"),
    ("CREDIT_CARD", r"\b\d{4}[\s-]?\d{4}[\s-]?\d{4}[\s-]?\d{4}\b"),
]
PERSON_NAME = r"\b[A-Z][a-z]+(?:\s+[A-Z][a-z]+)+\b"
PERSON_ALLOW_LIST = [
    "General Updates", "New Investment", "Private Investment", "Trust Account", "Family Office",
    "Asset Class", "North America", "South State", "West Coast", "East Coast", "New York", "Los Angeles",
]
LEAKAGE_PHRASES = [
    "how may we assist you", "submitted through", "priority level",
    "please select", "please specify", "additional information",
]

# Token statistics.
TOKEN = r"[A-Za-z]{4,}"
TFIDF_TOKEN = r"\b[a-zA-Z][a-zA-Z0-9\-]{1,}\b"
TOKEN_STOP_WORDS = [
    "client", "employee", "email", "phone", "please", "that", "this", "with", "from", "have",
    "been", "will", "they", "their", "into", "task", "name", "also", "would", "should", "could",
    "about", "which", "there", "were", "what", "when", "your", "more", "make", "need", "like",
    "just", "some", "than", "other", "each", "does", "very", "these", "those", "then", "only",
]
MASKED_STOP_WORDS = [
    "please", "that", "this", "with", "from", "have", "been", "will", "they", "their", "into",
    "task", "name", "email",
]

# Length buckets: upper bounds and labels.
LENGTH_BOUNDS = [0, 50, 150, 300, 600, 1200]
LENGTH_LABELS = ["0", "1-50", "51-150", "151-300", "301-600", "601-1200", ">1200"]
COMPLEXITY_BOUNDS = [79, 299]
COMPLEXITY_LABELS = ["Simple", "Medium", "Complex"]

# Keyword groups for the action mix (a text may fall into several).
ACTION_KEYWORDS = {
    "New/Setup": ["new account", "set up", "setup", "onboard", "add account", "create account",
                  "open account", "establish", "new client", "new fund", "new investment"],
    "Connect/Feed": ["feed", "connect", "data feed", "link", "integrate", "import", "automated",
                     "api", "portal access", "credentials"],
    "Fix/Resolve": ["fix", "resolve", "issue", "not showing", "error", "broken", "troubleshoot",
                    "discrepancy", "incorrect", "wrong", "duplicate", "stale"],
    "Update/Modify": ["update", "change", "modify", "adjust", "edit", "revise", "correct",
                      "rename", "amend"],
    "Review/Audit": ["review", "audit", "reconcile", "verify", "check", "monitor", "validate",
                     "confirm", "compare"],
    "Record/Track": ["record", "enter", "track", "log", "add entry", "capture", "note",
                     "distribution notice", "capital call"],
}

# Notes attached to a topic.
NOTE_LOW_CONFIDENCE = "Low confidence - consider absorbing into similar cluster"
NOTE_LOW_COHERENCE = "Low coherence - cluster may be too broad"
NOTE_SPLIT = "Split recommended (silhouette=%.3f)"
NOTE_MERGE = "Consider merging with topic(s): "
NOTE_MISFITS = " potential misclassifications flagged"
NOTE_NONE = "Cluster is cohesive and well-labeled"

# Bands: (lower bound, label), highest first.
DISTINCTIVENESS_BANDS = [(0.10, "Very high"), (0.05, "High"), (0.02, "Moderate"), (None, "Low")]
SIZE_BANDS = [(15.0, "largest"), (7.0, "major"), (3.0, "regular"), (None, "specialist")]
# Confidence buckets: (lower bound inclusive, label).
CONFIDENCE_BUCKETS = [(0.9, "0.90-1.00"), (0.7, "0.70-0.90"), (0.5, "0.50-0.70"), (None, "0.00-0.50")]
# What a text must hold for a pattern above or below to match: literals, or a
# cheaper pattern.  Texts without it are not searched; what several patterns in a row need is looked for once.
FOUR_DIGITS = r"\p{Nd}{4}"
NEEDS = {
    EMAIL: ["@"],
    URL: ["http", "www."],
    LABELLED_ID: FOUR_DIGITS,
    LONG_NUMBER: FOUR_DIGITS,
    PHONE: FOUR_DIGITS,
    r"https?://\S+": ["http"],
    r"\*{2,}": ["**"],
    r"<[^>]+>": ["<"],
    r"[-\x{2014}\x{2015}\x{2500}]{3,}\s*\n?This task was submitted.*": r"(?iu)task was submitted",
    r"This task was submitted through[^\n]*": r"(?iu)task was submitted",
    r"(?:best regards|kind regards|regards,|thank you in advance)[,.\s\n].*": r"(?iu)regards|thank you in",
    r"\[insert [^\]]+\]": ["["],
    r"^\s*-{4,}\s*$": ["----"],
    r"[\x{2014}\x{2015}\x{2500}\x{2501}\x{2550}]{3,}": ["\u2014", "\u2015", "\u2500", "\u2501", "\u2550"],
    r"\b\d{3}-\d{2}-\d{4}\b": FOUR_DIGITS,
    r"\b\d{4}[ \-]?\d{4}[ \-]?\d{4}[ \-]?\d{4}\b": FOUR_DIGITS,
}
# ------------------------------------------------------------ end fixed values
