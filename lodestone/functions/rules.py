"""Word lists, patterns and limits that results depend on."""

# The first pattern found in the first 2,000 characters names the document's type.
DOCUMENT_TYPES = [
    ("code", r"(?:```|def |class |import |from |function |const |let |var )"),
    ("markdown", r"(?:^#{1,6}\s|^\*{1,3}\s|^-\s|^\d+\.\s)"),
    ("structured", r"(?:^[A-Z][^.!?]*:\s*$|^\s*[-•]\s)"),
    ("legal", r"(?:WHEREAS|ARTICLE|Section \d|§)"),
    ("technical", r"(?:Figure \d|Table \d|Equation \d|Algorithm \d)"),
]

# The first pattern found in a lower-case query names its kind.
QUERY_PATTERNS = [
    ("factual_is", r"^(what|who|where|when|which|how)\s+is\s+"),
    ("factual_are", r"^(what|who|where|when|which|how)\s+are\s+"),
    ("wh_question", r"^(what|who|where|when|which|how)\s+"),
    ("yes_no", r"^(can|could|would|should|will|do|does|did)\s+"),
    ("explanation", r"^(explain|describe|tell me about)\s+"),
    ("comparison", r"^(compare|contrast|difference|vs|versus)\s+"),
    ("listing", r"^(list|enumerate|name|give me)\s+"),
    ("causal", r"^(why|reason|cause)\s+"),
    ("procedural", r"^(how to|steps to|guide|tutorial)\s+"),
    ("temporal", r"(latest|recent|current|today|news|update)\s+"),
    ("technical_code", r"(code|programming|function|script|algorithm)\s+"),
    ("mathematical", r"(calculate|compute|math|number|percentage)\s+"),
    ("definitional", r"(definition|define|meaning of)\s+"),
    ("summarization", r"(summarize|summary|tldr|brief)\s+"),
]

# Any of these in a lower-case query asks for several hops.
MULTIHOP = [
    r"who (?:is|was) the .+ of the .+ (?:that|which|who)",
    r"what (?:is|was) the .+ of the .+ (?:that|which|who)",
    r"where (?:is|was) the .+ (?:that|which|who)",
    r"which is (?:more|less|larger|smaller|better|worse)",
    r"compare .+ (?:and|with|to) .+",
    r"difference between .+ and .+",
    r"what happened (?:after|before|when) .+",
    r"who (?:succeeded|preceded|followed) .+",
    r"how many .+ (?:are|were) .+ and .+",
    r"what .+ and .+ have in common",
]

# Plain openings and complex markers of queries.
OPENINGS = ["what is", "who is", "when did", "where is"]
MARKERS = ["and", "but", "also", "additionally", "furthermore", "moreover", "compare", "contrast"]

# Words of a query that ask for the web.
WEB_WORDS = ["latest", "recent", "current", "today", "news", "update", "new", "2024", "2025", "now"]

# Kinds of a chunk by its beginning.
CHUNK_STARTS = [
    ("section", r"^#{1,6}\s+"),
    ("code_block", r"^(def |class |function |const )"),
    ("numbered_list", r"^\d+\.\s+"),
    ("bullet_list", r"^[-•*]\s+"),
]

# Upper bounds in milliseconds of a latency histogram.
LATENCY_BOUNDS = [10, 25, 50, 100, 250, 500, 1000, 2500, 5000, 10000]

# Weights of the statuses of a verified claim.
STATUS_WEIGHTS = {"supported": 1.0, "partially_supported": 0.7, "not_supported": 0.3, "contradicted": 0.0, "unverifiable": 0.5}

# The language of source files by extension.
CODE_EXTENSIONS = {
    "python": [".py", ".pyw", ".pyx"],
    "javascript": [".js", ".jsx", ".mjs"],
    "typescript": [".ts", ".tsx"],
    "java": [".java"],
    "kotlin": [".kt", ".kts"],
    "scala": [".scala"],
    "go": [".go"],
    "rust": [".rs"],
    "c": [".c", ".h"],
    "cpp": [".cpp", ".cc", ".cxx", ".hpp", ".hxx"],
    "csharp": [".cs"],
    "ruby": [".rb"],
    "php": [".php"],
    "swift": [".swift"],
    "r": [".r"],
    "shell": [".sh", ".bash", ".zsh"],
    "sql": [".sql"],
    "yaml": [".yaml", ".yml"],
    "json": [".json"],
    "markdown": [".md", ".mdx", ".rst", ".txt"],
}

# Content types by extension, and further ones that are read.
CONTENT_TYPES = {
    ".html": "text/html",
    ".htm": "text/html",
    ".txt": "text/plain",
    ".md": "text/markdown",
    ".pdf": "application/pdf",
    ".doc": "application/msword",
    ".docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
    ".xls": "application/vnd.ms-excel",
    ".xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet",
    ".ppt": "application/vnd.ms-powerpoint",
    ".pptx": "application/vnd.openxmlformats-officedocument.presentationml.presentation",
    ".json": "application/json",
    ".xml": "application/xml",
    ".rtf": "application/rtf",
}
MORE_CONTENT_TYPES = ["application/xhtml+xml", "text/x-markdown", "text/xml"]

# Extensions of media files.
AUDIO = [".mp3", ".wav", ".m4a", ".flac", ".ogg", ".aac", ".opus", ".wma", ".aiff", ".aif"]
VIDEO = [".mp4", ".mkv", ".webm", ".mov", ".avi", ".m4v", ".flv", ".wmv", ".ts"]
IMAGE = [".png", ".jpg", ".jpeg", ".gif", ".webp", ".bmp", ".tiff", ".tif"]
PLAIN = [".txt", ".md", ".rst"]

# Names of languages; others are named by their code in capitals.
LANGUAGES = {
    "en": "English",
    "zh": "Chinese",
    "es": "Spanish",
    "ar": "Arabic",
    "pt": "Portuguese",
    "ru": "Russian",
    "ja": "Japanese",
    "de": "German",
    "fr": "French",
    "ko": "Korean",
    "it": "Italian",
    "nl": "Dutch",
    "pl": "Polish",
    "tr": "Turkish",
    "vi": "Vietnamese",
    "th": "Thai",
    "id": "Indonesian",
    "cs": "Czech",
    "sv": "Swedish",
    "ro": "Romanian",
    "el": "Greek",
    "hu": "Hungarian",
    "da": "Danish",
    "fi": "Finnish",
    "no": "Norwegian",
    "hi": "Hindi",
    "bn": "Bengali",
    "ta": "Tamil",
    "ur": "Urdu",
    "fa": "Persian",
    "he": "Hebrew",
    "ms": "Malay",
    "sw": "Swahili",
    "zu": "Zulu",
    "af": "Afrikaans",
}

# Field names of JSON records, in order.
TEXT_FIELDS = ["content", "body", "text", "description", "message", "summary", "details", "value"]
TITLE_FIELDS = ["title", "name", "subject", "heading", "label", "key"]
KEPT_FIELDS = ["id", "timestamp", "date", "created_at", "updated_at", "type", "category", "level", "status"]
TIME_FIELDS = ["timestamp", "time", "date", "datetime", "created_at"]
LEVEL_FIELDS = ["level", "severity", "loglevel"]
MESSAGE_FIELDS = ["message", "msg", "log", "text"]
LOG_MARKS = ["level", "severity", "message", "msg", "log"]

# Entities that HTML text resolves, and link targets that are no pages.
ENTITIES = [("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"')]
NO_PAGES = "^(#|javascript:|mailto:|tel:)"

# The form of a citation marker: before, between and after the numbers.
MARKERS_BY_STYLE = {"inline": (" [", ", ", "]"), "footnote": ("^[", ",", "]"), "academic": (" (Source ", ", ", ")"), "hyperlink": (" [", ", ", "]"), "enterprise": (" {ref:", ",", "}")}

# Answers of a hop that add nothing to what is known, and the mode of the next attempt after each.
UNKNOWN_ANSWERS = ["unknown", "not found", ""]
MODE_CYCLE = {"hybrid": "dense", "dense": "bm25", "bm25": "hybrid"}

# Names of a repository's first file, in the order tried; the form of a link to a Markdown file.
READMES = ["README.md", "readme.md", "README.MD", "Readme.md"]
MARKDOWN_LINK = r"\[[^\]]+\]\(([^)#]+\.md)(?:#[^)]+)?\)"
