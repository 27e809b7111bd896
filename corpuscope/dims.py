"""Lists and lookup tables that decide results.

Everything here is data, not logic; the operators read it and build expressions from it.
"""

# The 13 chunk types.
CHUNK_TYPES = (
    "function", "class", "interface", "type", "enum", "import", "export",
    "decorator", "selector", "component", "config", "table", "heading",
)

# Chunk types that can be the target of a reference edge.
SYMBOL_TYPES = ("function", "class", "interface", "type", "enum")

# Chunk types whose text is not searched for calls.
NON_CALLING_TYPES = ("import", "decorator", "config")

# Words that look like calls but are not.
CALL_KEYWORDS = (
    "if", "while", "for", "switch", "catch", "return", "throw", "typeof", "new",
    "function", "class", "const", "let", "var", "async", "await", "import", "export",
)

# File extension -> language name (also the extension allow-list).
LANG_BY_EXT = {
    ".py": "python", ".js": "javascript", ".jsx": "javascript", ".ts": "typescript",
    ".tsx": "typescript", ".go": "go", ".rs": "rust", ".java": "java", ".rb": "ruby",
    ".php": "php", ".c": "c", ".h": "c", ".cpp": "cpp", ".hpp": "cpp", ".cs": "csharp",
    ".css": "css", ".scss": "scss", ".html": "html", ".hbs": "html", ".ejs": "html",
    ".json": "json", ".yaml": "yaml", ".yml": "yaml", ".toml": "toml",
    ".sql": "sql", ".md": "markdown",
}
CODE_EXTS = tuple(LANG_BY_EXT)

# Directory names skipped while listing a corpus.
IGNORED_DIRS = (
    "node_modules", "venv", "_venv", ".venv", ".git", "__pycache__", ".next", "dist",
    "build", "target", "bin", "obj", ".opencode", ".config", ".cache", ".vscode",
    ".idea", "vendor", "elixir_build",
)

# Directory names that mark generated files.
GENERATED_DIRS = (
    "dist", "build", "target", "node_modules", ".cache", "__pycache__", "vendor",
    "coverage", ".next",
)

# Generated base names and sensitive paths.
GENERATED_NAME_RE = r"(?i)\.min\.|\.umd\.|\.prod\.|\.dev\.|bundle|generated"
SENSITIVE_PATH_RES = (
    r"(^|/)\.env(\..*)?$",
    r"(^|/)\.aws(/|$)",
    r"(^|/)\.ssh(/|$)",
    r"\.pem$",
    r"\.key$",
    r"(^|/)\.git(/|$)",
    r"(?i)(^|/)[^/]*credentials[^/]*$",
    r"(^|/)cdk\.context\.json$",
    r"(^|/)cdk\.out(/|$)",
)

# Corpus limits.
MAX_FILE_BYTES = 1024 * 1024
MAX_FILES = 10_000
MAX_CONTENT_CHARS = 200

# Project discovery.
PROJECT_MARKERS = (
    ".git", "package.json", "Cargo.toml", "go.mod", "pyproject.toml", "pom.xml",
    "build.gradle", "build.gradle.kts", "Gemfile", "composer.json", "mix.exs",
    "deno.json", "bun.lockb", "pnpm-lock.yaml",
)
PROJECT_SUFFIX_RE = r"\.(xcodeproj|xcworkspace)$"
DISCOVERY_SKIP_DIRS = (
    "node_modules", ".git", "dist", "build", "target", ".cache", ".venv", "venv",
    "vendor", "__pycache__", ".next", ".opencode", ".config", ".idea", ".vscode",
    ".gradle", ".tox", "Pods",
)
MAX_DISCOVERED = 50

# Suffixes probed, in order, to resolve imports and bare names.
IMPORT_SUFFIXES = (
    ".ts", ".tsx", ".js", ".jsx", "/index.ts", "/index.tsx", "/index.js", "/index.jsx",
)
NAME_SUFFIXES = (
    ".ts", ".tsx", ".js", ".jsx", ".py", ".go", ".rs", ".java", ".rb", ".php", ".c",
    ".cpp", ".cs",
)

# Compaction caps per tool; the keys are the eligible tools.
TOOL_MAX_LINES = {
    "read": 25, "bash": 30, "sh": 30, "zsh": 30, "fish": 30, "shell": 30,
    "grep": 25, "rg": 25, "fd": 25, "find": 25, "glob": 50,
    "npm": 20, "yarn": 20, "pnpm": 20, "node": 30, "npx": 30, "tsc": 30, "deno": 30,
    "bun": 30, "git": 20, "curl": 20, "wget": 20, "ssh": 10, "scp": 10,
    "test": 30, "jest": 30, "vitest": 30, "pytest": 30, "cargo": 30, "go": 30,
    "rustc": 30, "build": 20, "make": 20, "cmake": 20, "docker": 20, "kubectl": 20,
    "related": 25, "impact": 25, "search": 20,
}
DEFAULT_MAX_LINES = 30
TOOL_MAX_CHARS = {"read": 12_000, "bash": 16_000, "grep": 12_000, "rg": 12_000, "test": 12_000}
DEFAULT_MAX_CHARS = 50_000
COMPACTION_THRESHOLD = 8_000

# Tools by summary family.
SHELL_TOOLS = ("bash", "sh", "zsh", "fish", "shell")
TEST_TOOLS = ("test", "jest", "vitest", "pytest")
GREP_TOOLS = ("grep", "rg")
GLOB_TOOLS = ("glob", "find", "fd")

# Tools the client side compacts (any bash*/sh* name also counts).
CLIENT_TOOLS = (
    "read", "bash", "sh", "zsh", "fish", "shell", "grep", "glob", "rg", "fd", "find",
    "npm", "yarn", "pnpm", "node", "npx", "tsc", "git", "curl", "wget", "ssh", "scp",
    "test", "jest", "vitest", "pytest", "cargo", "build", "make", "cmake",
)
# Command heads the reduced classifier compacts.
REDUCED_TOOLS = (
    "git", "npm", "yarn", "pnpm", "node", "npx", "tsc", "test", "jest", "vitest",
    "pytest", "cargo", "build", "make", "cmake",
)

# Shell command heads that read a file, and that search in one.
READ_COMMANDS = (
    "cat", "head", "tail", "less", "more", "bat", "batcat", "xxd", "strings", "base64",
    "md5sum", "sha1sum", "sha256sum", "wc", "file", "stat", "du", "fold", "column", "rev",
    "awk", "sed", "cut", "tr", "sort", "uniq", "nl", "paste", "comm", "join", "tac", "dd",
    "iconv", "od", "hexdump", "tokei", "scc", "cloc",
)
GREP_COMMANDS = ("grep", "rg", "ripgrep", "ag", "ack", "pt", "sift", "ugrep")

# Usage event type -> savings mechanism, in reporting order.
MECHANISM_BY_EVENT = {
    "index_substitute": "indexSubstitution",
    "file_read": "indexSubstitution",
    "search_savings": "searchSnippets",
    "compression": "compression",
    "semantic_compression": "semanticCompression",
    "cache_hit": "cacheHit",
}
MECHANISMS = (
    "indexSubstitution", "searchSnippets", "compression", "semanticCompression", "cacheHit",
)
# Event types whose savings are counted in a project summary.
SAVING_EVENTS = (
    "index_substitute", "semantic_compression", "compression", "search_savings",
    "generative_compression", "output_compression",
)

# Timeline periods: truncation unit, buckets, key format.
PERIODS = {
    "year": ("month", 12, "yyyy-MM"),
    "month": ("day", 30, "yyyy-MM-dd"),
    "week": ("day", 7, "yyyy-MM-dd"),
    "day": ("hour", 24, "yyyy-MM-dd'T'HH"),
}
DEFAULT_PERIOD = "week"

# Search limits and BM25 constants.
MAX_TERMS = 30
DEFAULT_RESULTS = 10
MAX_RESULTS = 200
BM25_K1 = 1.2
BM25_B = 0.75
BM25_MIN_IDF = 1e-6
