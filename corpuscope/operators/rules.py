"""Declaration rules per language: the extension point of the symbol extractor.

A rule says where a declaration starts, not how to walk a file. Rules match at the start of a
line (after its indent). ``name``, ``aux`` and ``alt`` are the named groups a rule may fill; a
non-empty ``alt`` wins over ``name``. ``content`` is a template over {name}, {aux} and {full};
``extent`` says how the end is found:

    line    the declaration's own line          brace   the matching close brace
    indent  the last deeper-indented line       end     the matching ``end`` line
    arrow   statement end, or brace             alias   same, other one-line test
    body    brace if the line opens one, else its own line

Patterns are fixed values: they decide which declarations are found. ``\\h`` is a blank that is
not a line break; multi-line rules use ``\\s``.
"""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Rule:
    type: str
    code: str  # middle part of the chunk id
    pattern: str
    content: str = "{full}"
    extent: str = "line"
    scope: bool = False  # opens a scope that qualifies the names inside it
    member: bool = False  # takes the qualified name inside a scope


@dataclass(frozen=True)
class Language:
    rules: tuple[Rule, ...]
    first_only: bool  # at most one rule per line, in order
    tokens: str = "c"  # how strings and comments are written
    keyword_ends: bool = False


JS = (
    Rule("function", "fn", r"(?:export\s+)?(?:async\s+)?function\s+(?<name>\w+)\s*\((?<aux>[^)]*)\)",
         "function {name}({aux})", "brace"),
    Rule("function", "fn",
         r"(?:export\s+)?(?:const|let|var)\s+(?<name>\w+)\s*=\s*(?:async\s+)?(?:\((?<aux>[^)]*)\)|(?<aux2>\w+))\s*=>",
         "const {name} = ({aux}) =>", "arrow"),
    Rule("class", "cls",
         r"(?:export\s+)?(?:abstract\s+)?class\s+(?<name>\w+)(?:\s+extends\s+\w+)?(?:\s+implements\s+[\w,\s]+)?\s*\{",
         "class {name}", "brace"),
    Rule("function", "fn",
         r"(?:(?:public|private|protected|static|async|get|set|accessor|readonly)\s+)*"
         r"(?!if|while|for|switch|catch|else|return|throw|case|typeof|new|import|export|function|class|interface"
         r"|type|enum|const|let|var|await)(?<name>\w+)\s*\((?<aux>[^)]*)\)(?:\s*:\s*[^{]+)?\s*\{",
         "method {name}({aux})", "brace"),
    Rule("import", "imp", r"import\s+(?<name>\w+)\s+from\s+['\"][^'\"]+['\"]"),
    Rule("import", "imp", r"import\s+\{\s*(?<name>\w+)[^}]*\}\s+from\s+['\"][^'\"]+['\"]"),
    Rule("import", "imp", r"import\s+\*\s+as\s+(?<name>\w+)\s+from\s+['\"][^'\"]+['\"]"),
    Rule("import", "imp", r"import\s+['\"](?<name>[^'\"]+)['\"]"),
    Rule("import", "imp", r"(?:const|let|var)\s+(?<name>\w+)\s*=\s*require\s*\(\s*['\"][^'\"]+['\"]\s*\)"),
    Rule("export", "exp",
         r"export\s+(?:default\s+)?(?:function|class|interface|type|enum|const|let|var)\s+(?<name>\w+)"),
    Rule("export", "exp", r"export\s+\{\s*(?<name>\w+)"),
    Rule("export", "exp", r"export\s+(?<name>\*)\s+from\s+['\"][^'\"]+['\"]"),
    Rule("export", "exp",
         r"export\s+default\s+(?!(?:function|class|interface|type|enum)(?!\w))(?<name>\w+)"),
    Rule("decorator", "dec", r"@(?<name>\w+)(?:\s*\((?<aux>[^)]*)\))?", "@{name}{aux?}"),
)

TS = JS + (
    Rule("interface", "iface", r"(?:export\s+)?interface\s+(?<name>\w+)(?:\s+extends\s+[\w,\s]+)?\s*\{",
         "interface {name}", "brace"),
    Rule("type", "type", r"(?:export\s+)?type\s+(?<name>\w+)\s*=", "type {name}", "alias"),
    Rule("enum", "enum", r"(?:export\s+)?(?:const\s+)?enum\s+(?<name>\w+)\s*\{", "enum {name}", "brace"),
)

PYTHON = (
    Rule("decorator", "dec", r"@(?<name>\w+)(?:\.\w+)*(?:\h*\([^)\n]*\))?", "{line}"),
    Rule("class", "cls", r"class\h+(?<name>\w+)\h*(?<aux>\([^)\n]*\))?\h*:", "class {name}{aux}", "indent", scope=True),
    Rule("function", "fn", r"(?:async\h+)?def\h+(?<name>\w+)\h*\((?<aux>[^)\n]*)\)\h*(?<tail>->\h*[^:\n]+)?\h*:",
         "{method}def {name}({aux}){tail}", "indent", member=True),
    Rule("import", "imp", r"import\h+(?<name>\w+)", "{line}"),
    Rule("import", "imp", r"from\h+\S+\h+import\h+(?<name>\w+)", "{line}"),
)

GO = (
    Rule("function", "fn",
         r"func\s+(?:\([^)]*\)\s+)?(?<name>\w+)\s*\((?<aux>[^)]*)\)(?:\s*\([^)]*\)|\s+\w+(?:\s*\*?\w+)?)?\s*\{",
         "func {name}({aux})", "brace"),
    Rule("class", "cls", r"type\s+(?<name>\w+)\s+struct\s*\{", "struct {name}", "brace"),
    Rule("interface", "iface", r"type\s+(?<name>\w+)\s+interface\s*\{", "interface {name}", "brace"),
    Rule("import", "imp", r"import\s+(?:\(?\s*['\"](?<name>[^'\"]+)['\"]|\w+\s+['\"](?<name2>[^'\"]+)['\"])"),
)

RUST = (
    Rule("class", "cls", r"(?:pub\h+)?struct\h+(?<name>\w+)", "struct {name}", "body", scope=True),
    Rule("enum", "enum", r"(?:pub\h+)?enum\h+(?<name>\w+)", "enum {name}", "body", scope=True),
    Rule("interface", "iface", r"(?:pub\h+)?trait\h+(?<name>\w+)", "trait {name}", "body", scope=True),
    Rule("class", "cls",
         r"impl\b(?=(?:\h*<[^>\n]*>)?\h+\w)(?:\h*<[^>\n]*>)?\h+(?:(?<name>\w+)(?:\h*<[^>\n]*>)?\h+)?(?:for\h+(?<alt>\w+))?",
         "impl {name}", "brace", scope=True),
    Rule("function", "fn", r"(?:pub\h+)?(?:unsafe\h+)?fn\h+(?<name>\w+)(?:\h*<[^>\n]+>)?\h*\((?<aux>[^)\n]*)\)",
         "{method}fn {name}({aux})", "brace", member=True),
    Rule("import", "imp", r"use\h+(?:\w+::)*(?<name>\w+)(?:::\{&|\*\})?(?:\h+as\h+(?<alt>\w+))?", "{line}"),
    Rule("import", "imp", r"extern\h+crate\h+(?<name>\w+)", "{line}"),
    Rule("export", "exp", r"pub\h+use\h+(?:\w+::)*(?<name>\w+)", "{line}"),
    Rule("export", "exp", r"pub\h+mod\h+(?<name>\w+)", "{line}"),
)

JAVA = (
    Rule("decorator", "dec", r"@(?<name>\w+)(?:\h*\([^)\n]*\))?", "{line}"),
    Rule("class", "cls",
         r"(?:public\h+|private\h+|protected\h+)?(?:abstract\h+|final\h+|static\h+)*class\h+(?<name>\w+)",
         "class {name}", "brace", scope=True),
    Rule("interface", "iface", r"(?:public\h+)?interface\h+(?<name>\w+)", "interface {name}", "brace"),
    Rule("enum", "enum", r"(?:public\h+)?enum\h+(?<name>\w+)", "enum {name}", "brace"),
    Rule("function", "fn",
         r"(?:public|private|protected)\h+(?:static\h+)?(?:\w+(?:\h*<[^>\n]+>)?\h+)?(?<name>\w+)\h*\((?<aux>[^)\n]*)\)",
         "method {name}({aux})", "brace", member=True),
    Rule("import", "imp", r"import\h+(?:static\h+)?(?:\w+\.)*(?<name>\w+)", "{line}"),
)

RUBY = (
    Rule("class", "cls", r"(?<aux>class|module)\h+(?<name>\w+)", "{aux} {name}", "end", scope=True),
    Rule("function", "fn", r"def\h+(?:self\.)?(?<name>\w+)[.!?]?\h*(?:\((?<aux>[^)\n]*)\))?",
         "{method}def {name}({aux})", "end", member=True),
    Rule("import", "imp", r"require\h+['\"](?<name>[^'\"\n]+)['\"]", "{line}"),
    Rule("import", "imp", r"(?:include|extend)\h+(?<name>\w+)", "{line}"),
)

PHP = (
    Rule("class", "cls", r"(?:final\h+|abstract\h+)?class\h+(?<name>\w+)", "class {name}", "brace", scope=True),
    Rule("interface", "iface", r"interface\h+(?<name>\w+)", "interface {name}", "brace"),
    Rule("interface", "iface", r"trait\h+(?<name>\w+)", "trait {name}", "brace"),
    Rule("enum", "enum", r"enum\h+(?<name>\w+)", "enum {name}", "brace"),
    Rule("function", "fn",
         r"(?:(?:public|private|protected)\h+)?(?:static\h+)?function\h+(?<name>\w+)\h*\((?<aux>[^)\n]*)\)",
         "{method}function {name}({aux})", "brace", member=True),
    Rule("import", "imp", r"(?![^\n]*(?:function|const))use\h+(?<name>\w+)", "{line}"),
    Rule("import", "imp", r"(?:require|include)(?:_once)?\h+['\"][^'\"\n]+['\"]", "{line}"),  # named "file"
)

CPP = (
    Rule("class", "cls", r"(?:final\h+)?class\h+(?<name>\w+)", "class {name}", "brace", scope=True),
    Rule("class", "cls", r"struct\h+(?<name>\w+)", "class {name}", "brace", scope=True),
    Rule("class", "cls", r"(?![^\n]*=)namespace\h+(?<name>\w+)", "namespace {name}", "brace"),
    Rule("enum", "enum", r"(?:enum\h+class\h+|enum\h+struct\h+|enum\h+)(?<name>\w+)", "enum {name}", "brace"),
    Rule("function", "fn",
         r"(?!template)(?:(?:static|inline|extern|constexpr|virtual|override|const|noexcept)\h+)*"
         r"(?:\w+(?:[\h*]|(?<=\h)&)+)?(?!if|while|for|switch|return|catch)(?<name>\w+)\h*\((?<aux>[^)\n]*)\)"
         r"\h*(?:const|noexcept|override|final)*\h*\{",
         "{method}{name}({aux})", "brace", member=True),
    Rule("import", "imp", r"#include\h+[<\"](?<name>[^>\"\n]+)[\">]", "{line}"),
)

CSHARP = (
    Rule("class", "cls", r"(?:public\h+|internal\h+|abstract\h+|sealed\h+|static\h+)*class\h+(?<name>\w+)",
         "class {name}", "brace", scope=True),
    Rule("class", "cls", r"(?:public\h+|internal\h+)?struct\h+(?<name>\w+)", "class {name}", "brace", scope=True),
    Rule("class", "cls", r"(?:public\h+|internal\h+)?record\h+(?<name>\w+)", "class {name}", "brace", scope=True),
    Rule("interface", "iface", r"(?:public\h+|internal\h+)?interface\h+(?<name>\w+)", "interface {name}", "brace"),
    Rule("enum", "enum", r"(?:public\h+|internal\h+)?enum\h+(?<name>\w+)", "enum {name}", "brace"),
    Rule("function", "fn",
         r"(?:(?:public|private|protected|internal)\h+)?(?:(?:static|virtual|override|abstract|async|sealed)\h+)*"
         r"\w+(?:\h*<[^>\n]+>)?\h+(?<name>\w+)\h*\((?<aux>[^)\n]*)\)",
         "method {name}({aux})", "brace", member=True),
    Rule("import", "imp", r"using\h+(?:static\h+)?(?:\w+\.)*(?<name>\w+)", "{line}"),
)

CSS = (
    Rule("selector", "sel", r"(?<name>\.-?[_a-zA-Z][\w-]*|#-?[_a-zA-Z][\w-]*)", "{name}"),
    Rule("selector", "sel", r"(?!@import(?!\w))(?<name>@\w+)", "{name}"),
    Rule("selector", "sel", r"(?<name>--[\w-]+)\s*:", "{name}"),
)

# Keys stand at the very start of a line, except JSON keys, which may be indented.
DATA = (
    Rule("config", "cfg", r"\"(?<name>\w+)\"\s*:", "{name}"),
    Rule("config", "cfg", r"(?<=^|\n)(?:-\s+)?(?<name>\w[\w_-]*)\s*:(?=\s|\||>|\z)", "{name}"),
    Rule("config", "cfg", r"(?<=^|\n)\[(?<name>\w+(?:\.\w+)*)\]", "{name}"),
)

MARKDOWN = (Rule("heading", "h", r"(?<=^|\n)#+\s+(?<name>[^\n\r]+)", "{full}"),)

LANGUAGES: dict[str, Language] = {
    "javascript": Language(JS, False),
    "typescript": Language(TS, False),
    "python": Language(PYTHON, True),
    "go": Language(GO, False),
    "rust": Language(RUST, True, tokens="rust"),
    "java": Language(JAVA, True),
    "ruby": Language(RUBY, True, keyword_ends=True),
    "php": Language(PHP, True),
    "c": Language(CPP, True),
    "cpp": Language(CPP, True),
    "csharp": Language(CSHARP, True),
    "css": Language(CSS, False),
    "scss": Language(CSS, False),
    "json": Language(DATA, False),
    "yaml": Language(DATA, False),
    "toml": Language(DATA, False),
    "markdown": Language(MARKDOWN, False),
}


@dataclass(frozen=True)
class InlineRule:
    """A pattern that may match anywhere and several times per line."""

    type: str
    code: str
    lead: str  # part before the place that is reported
    pattern: str  # the reported part; group ``group`` is the name
    group: int
    content: str


INLINE: dict[str, tuple[InlineRule, ...]] = {
    "html": (
        InlineRule("component", "cmp", "", r"<([A-Z]\w*)[\s>]", 1, "{full}"),
        InlineRule("component", "cmp", r"\s", r"(?:id|data-testid)=[\"']([^\"']+)[\"']", 1, "{full}"),
    ),
    "sql": (
        InlineRule(
            "table", "tbl", "",
            r"(?i)CREATE\s+(?:TEMPORARY\s+)?(?:TABLE|INDEX|VIEW|TRIGGER)\s+(?:IF\s+NOT\s+EXISTS\s+)?(?:\w+\.)?(\w+)",
            1, "{full}",
        ),
        InlineRule("table", "tbl", "", r"(?i)\bFROM\s+(\w+)", 1, "{full}"),
    ),
}

# Strings, comments and brackets. Literals are possessive so that long ones do not recurse;
# import and export lists are single tokens, because their braces open no block.
_LIST = r"(?:(?<=\n)|(?<![\s\S]))\h*(?:import|export)\h*\{[^{}]*\}"
_QUOTED = r"\"(?:\\[\s\S]|[^\"\\])*+\""
_SINGLE = r"'(?:\\[\s\S]|[^'\\])*+'"
_BACKTICK = r"`(?:\\[\s\S]|[^`\\])*+`"
_COMMENT = r"//[^\n]*+|/\*[\s\S]*?\*/"
TOKEN_RES = {
    "c": "|".join((_LIST, _COMMENT, _QUOTED, _SINGLE, _BACKTICK, r"[{}()]|\n")),
    # A quote followed by an identifier is a lifetime, not a string.
    "rust": "|".join((_COMMENT, _QUOTED, r"'(?:\\[^\n]|[^'\\\n])'", r"[{}()]|\n")),
}

# Lines that open and close blocks in keyword-ended languages.
KEYWORD_OPEN_RE = r"^\s*(?:class |module |def |(?:if|unless|while|until|for|begin|case)\b)"
KEYWORD_CLOSE_RE = r"^\s*end\s*$"

# One-line tests of statement-ended declarations.
ARROW_ONE_LINE_RE = r"=>\s*[^;{}]+$|=>\s*[^;{}]*;\s*$"
STATEMENT_END_RE = r"([;{])\s*$"
