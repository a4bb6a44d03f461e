"""Word lists, patterns and constants that decide results.

They are contract values of the computations, stated once, in natural order.
"""

# Stop words of the frequency keywords.
KEYWORD_STOP_WORDS = (
    "the", "a", "an", "and", "or", "but", "in", "on", "at", "to", "for",
    "of", "with", "by", "from", "as", "is", "was", "are", "were", "been",
    "be", "have", "has", "had", "do", "does", "did", "will", "would",
    "could", "should", "may", "might", "must", "shall", "can", "need",
    "it", "its", "this", "that", "these", "those", "i", "you", "he",
    "she", "we", "they", "what", "which", "who", "when", "where", "why",
    "how", "all", "each", "every", "both", "few", "more", "most", "other",
    "some", "such", "no", "nor", "not", "only", "own", "same", "so",
    "than", "too", "very", "just", "also", "now", "here", "there",
)

# Words whose rates are embedding features, in feature order.
EMBEDDING_WORDS = (
    "the", "a", "an", "is", "are", "was", "were", "be", "been", "being",
    "have", "has", "had", "do", "does", "did", "will", "would", "could", "should",
)

# Language names by code.
LANGUAGE_NAMES = {
    "en": "English",
    "es": "Spanish",
    "fr": "French",
    "de": "German",
    "it": "Italian",
    "pt": "Portuguese",
    "nl": "Dutch",
    "pl": "Polish",
    "ru": "Russian",
    "ja": "Japanese",
    "ko": "Korean",
    "zh-cn": "Chinese (Simplified)",
    "zh-tw": "Chinese (Traditional)",
    "ar": "Arabic",
    "hi": "Hindi",
    "tr": "Turkish",
    "sv": "Swedish",
    "da": "Danish",
    "no": "Norwegian",
    "fi": "Finnish",
}

# Frequent function words per language, the profile of the language guess.
LANGUAGE_PROFILES = {
    "en": ("the", "of", "and", "to", "in", "is", "it", "that", "was", "for", "on", "with", "as", "are", "by"),
    "es": ("el", "los", "las", "del", "una", "por", "con", "para", "que", "como", "más", "pero", "sus", "este", "y"),
    "fr": ("le", "les", "des", "une", "dans", "est", "pour", "pas", "sur", "avec", "qui", "ce", "et", "au", "ne"),
    "de": ("der", "die", "und", "das", "den", "von", "zu", "mit", "sich", "auf", "für", "ist", "nicht", "ein", "dem"),
    "it": ("il", "di", "che", "per", "della", "sono", "gli", "nel", "anche", "più", "alla", "come", "questo", "dei"),
    "pt": ("o", "os", "uma", "não", "mais", "dos", "foi", "pelo", "também", "são", "pela", "até", "isso", "ao"),
    "nl": ("het", "een", "van", "niet", "zijn", "voor", "met", "ook", "maar", "naar", "deze", "worden", "wordt"),
    "pl": ("się", "nie", "jest", "na", "że", "jak", "ale", "przez", "tego", "który", "oraz", "dla", "po"),
    "sv": ("och", "att", "det", "som", "är", "inte", "till", "från", "har", "hade", "eller", "efter"),
    "da": ("og", "af", "ikke", "til", "blev", "eller", "efter", "hvor", "også", "mere", "være"),
    "no": ("og", "ikke", "til", "ble", "etter", "hvor", "også", "mer", "være", "noen"),
    "fi": ("ja", "on", "ei", "että", "oli", "hän", "mutta", "myös", "kuin", "ovat", "tai"),
}

# Keywords that mark a question about statistics.
STATS_KEYWORDS = (
    "stats", "statistics", "how many", "documents processed",
    "conversions", "converted", "success rate", "failed",
    "processing time", "file types", "today", "total",
    "numbers", "metrics", "count", "average",
)

# Words that call for an outside search.
SEARCH_TRIGGERS = (
    "legal", "compliance", "regulation", "law", "standard",
    "industry", "best practice", "benchmark", "compare",
)

# Statements a read-only sandbox refuses, in checking order.
BLOCKED_KEYWORDS = (
    "INSERT", "UPDATE", "DELETE", "DROP", "CREATE", "ALTER",
    "TRUNCATE", "REPLACE", "MERGE", "GRANT", "REVOKE",
    "ATTACH", "DETACH", "VACUUM", "REINDEX", "ANALYZE",
)
MAX_RESULT_ROWS = 1000

# File name endings accepted for conversion.
CONVERTIBLE_EXTENSIONS = (
    ".pdf", ".docx", ".doc", ".txt", ".xlsx", ".xls", ".csv", ".pptx", ".ppt",
    ".jpg", ".jpeg", ".png", ".gif", ".bmp", ".webp", ".html", ".htm", ".json", ".xml", ".epub", ".zip",
)
MAX_FILE_BYTES = 50 * 1024 * 1024

# Leading bytes and the endings they may carry.
MAGIC_BYTES = (
    (b"%PDF", (".pdf",)),
    (b"PK\x03\x04", (".docx", ".xlsx", ".pptx", ".zip", ".epub")),
    (b"\xd0\xcf\x11\xe0", (".doc", ".xls", ".ppt")),
    (b"\xff\xd8\xff", (".jpg", ".jpeg")),
    (b"\x89PNG", (".png",)),
    (b"GIF8", (".gif",)),
    (b"BM", (".bmp",)),
    (b"RIFF", (".webp",)),
    (b"<!DOCTYPE", (".html", ".htm")),
    (b"<html", (".html", ".htm")),
    (b"<?xml", (".xml",)),
    (b"{", (".json",)),
    (b"[", (".json",)),
    (b"SQLite format 3", (".db", ".sqlite", ".sqlite3")),
)
TEXT_EXTENSIONS = (".txt", ".csv", ".json", ".xml", ".sql")

# Content types and the ending given to a file name without one.
CONTENT_TYPE_EXTENSIONS = {
    "application/pdf": ".pdf",
    "application/vnd.openxmlformats-officedocument.wordprocessingml.document": ".docx",
    "application/msword": ".doc",
    "text/html": ".html",
    "text/plain": ".txt",
}

# Request limits.
RATE_LIMIT_REQUESTS = 200
RATE_LIMIT_WINDOW_SECONDS = 60
ABUSE_THRESHOLD = 100
ABUSE_BLOCK_SECONDS = 3600
HONEYPOT_PENALTY = 10
CIRCUIT_FAILURES = 5
CIRCUIT_RESET_SECONDS = 60
CIRCUIT_SUCCESSES = 3
SESSION_IDLE_SECONDS = 3600
SESSION_MAX_ITEMS = 10
SESSION_MAX_CHARS = 1024 * 1024

# Cost baseline in dollars per million tokens.
BASELINE_PROMPT_PRICE = 10.0
BASELINE_COMPLETION_PRICE = 30.0

# Display name of a model and its identifier.
MODEL_IDS = {
    "Google Gemini 2.0 Flash": "google/gemini-2.0-flash-001",
    "DeepSeek V3": "deepseek/deepseek-chat",
    "DeepSeek R1": "deepseek/deepseek-r1",
    "Meta Llama 3.3 70B": "meta-llama/llama-3.3-70b-instruct",
    "Mistral Small": "mistralai/mistral-small-24b-instruct-2501",
    "Google Gemini Flash (Free)": "google/gemini-2.0-flash-exp:free",
    "DeepSeek (Free)": "deepseek/deepseek-chat-v3-0324:free",
}
DEFAULT_MODEL = "Google Gemini 2.0 Flash"

# Order in which models are tried after a failure.
FALLBACK_ORDER = (
    "DeepSeek V3",
    "Google Gemini 2.0 Flash",
    "Meta Llama 3.3 70B",
    "Mistral Small",
    "DeepSeek R1",
    "Google Gemini Flash (Free)",
    "DeepSeek (Free)",
)
MAX_FALLBACKS = 5

# Model per complexity level (primary, fallback).
LEVELS = ("simple", "moderate", "complex")
LEVEL_MODELS = {
    "simple": ("Google Gemini 2.0 Flash", "Mistral Small 3.1"),
    "moderate": ("DeepSeek V3", "Meta Llama 4 Scout"),
    "complex": ("Meta Llama 4 Maverick", "Google Gemini 2.5 Pro"),
}
DOMAIN_FLOORS = {"legal": "moderate", "medical": "moderate"}

# Prompt signals of the router.
SIMPLE_MAX_WORDS = 50
COMPLEX_MIN_WORDS = 150
TECHNICAL_TERM_THRESHOLD = 4
SIMPLE_PATTERNS = (
    r"^(what|who|when|where|how many|how much)\b",
    r"^(summarize|summary)\b",
    r"^(list|enumerate)\b",
    r"^(define|definition)\b",
    r"^(explain briefly|quick)\b",
    r"^(hi|hello|hey|thanks|thank you)\b",
    r"^(yes|no|ok|okay)\b",
)
COMPLEX_PATTERNS = (
    r"\b(analyze|analysis|evaluate|assessment)\b",
    r"\b(compare|contrast|differentiate)\b",
    r"\b(implications|consequences|impact)\b",
    r"\b(trade-?offs?|pros and cons)\b",
    r"\b(legal|compliance|regulatory|statute)\b",
    r"\b(medical|clinical|diagnosis|treatment)\b",
    r"\b(multi-?step|detailed|comprehensive|thorough)\b",
    r"\b(why|reasoning|rationale|justify)\b",
    r"\b(strategy|strategic|recommend)\b",
)
TECHNICAL_PATTERN = (
    r"\b(API|SDK|algorithm|implementation|architecture|"
    r"optimization|latency|throughput|scalability|"
    r"compliance|regulation|jurisdiction|"
    r"diagnosis|prognosis|contraindication|"
    r"encryption|authentication|authorization)\b"
)

# Weights of the judged dimensions per kind of response.
DIMENSION_WEIGHTS = {
    "chat": {"relevance": 1.5, "accuracy": 1.5, "helpfulness": 1.0, "safety": 1.0, "completeness": 0.5},
    "investigation": {
        "relevance": 1.5, "accuracy": 2.0, "depth": 1.5, "actionability": 1.0, "citation_quality": 1.0,
    },
    "sql": {"query_correctness": 2.0, "efficiency": 1.0, "safety": 1.5, "explanation_quality": 1.0},
}
QUALITY_THRESHOLD = 7.0
MAX_RETRIES = 2

# Alert limits (metric, title, limit, level).
ALERT_LIMITS = (
    ("cpu_percent", "High CPU Usage", 90.0, "warning"),
    ("memory_percent", "High Memory Usage", 90.0, "critical"),
    ("disk_percent", "Low Disk Space", 90.0, "critical"),
    ("error_rate", "High Error Rate", 0.05, "critical"),
)

# Upper bounds of the latency histogram buckets in seconds.
LATENCY_BUCKETS = (0.005, 0.01, 0.025, 0.05, 0.075, 0.1, 0.25, 0.5, 0.75, 1.0, 2.5, 5.0, 7.5, 10.0)

# Concurrency limits.
MAX_CONCURRENT = 5
MAX_CONCURRENT_HEAVY = 2
