"""Patterns by language: extensions, definitions, imports.

A definition pattern has two groups: what stands before the definition on its
line, and the name.  An import pattern has the same two, with what is imported;
where a comma lists several modules, its second group is the whole list.
A definition is looked for in a line and what is ahead of it (``lexical.ahead``):
a parameter list may go on over lines, and a brace may stand on its own.  They
find what usual formatting writes; they are no grammar.
"""

from __future__ import annotations

from dataclasses import dataclass, field

NAME = r"([A-Za-z_$][\w$]*)"
#: A list in brackets, whose parts may have brackets of their own.
LIST = r"\((?:[^();]|\((?:[^();]|\([^();]*\))*\))*\)"
#: No name of a function stands here.
NOT_NAMED = r"(?!(?:if|for|foreach|while|do|switch|case|catch|try|finally|else|return|throw|new|using|lock|fixed|synchronized|function|await|yield|typeof|super|this)\b)"


@dataclass(frozen=True)
class Language:
    name: str
    extensions: tuple[str, ...]
    definitions: tuple[tuple[str, str], ...] = ()
    imports: tuple[str, ...] = ()
    nesting: str = "brace"  # or "indent" or "end"
    comment: str = "//"
    calls: str = r"(?<!\w)" + NAME + r"\s*\("
    keywords: tuple[str, ...] = field(default=("if", "for", "while", "switch", "return", "catch", "function", "func", "fn", "def", "class", "elif", "and", "or", "not", "in", "print!", "sizeof", "match", "when", "with", "assert", "await", "new", "else", "super", "foreach", "until", "unless", "lambda", "yield"))
    #: Those of the imports whose second group is a comma list, each of its parts a name.
    lists: tuple[str, ...] = ()


_JS = (
    ("function", r"^(\s*(?:export\s+)?(?:default\s+)?)(?:async\s+)?function\s*\*?\s*" + NAME),
    ("function", r"^(\s*(?:export\s+)?(?:const|let|var)\s+)" + NAME + r"\s*(?::[^=]+)?=\s*(?:async\s*)?(?:function\b|" + LIST + r"\s*(?::[^=]+)?=>|\w+\s*=>)"),
    ("class", r"^(\s*(?:export\s+)?(?:default\s+)?)(?:abstract\s+)?class\s+" + NAME),
    ("method", r"^(\s*(?:static\s+|async\s+|get\s+|set\s+)*)" + NOT_NAMED + NAME + r"\s*(?:<[^>()]*>\s*)?" + LIST + r"\s*(?::\s*[^{]+)?\{\s*$"),
    ("constant", r"^((?:export\s+)?(?:const|let)\s+)" + NAME + r"\s*(?::[^=]+)?=(?!\s*(?:async\s*)?(?:function\b|" + LIST + r"\s*(?::[^=]+)?=>|\w+\s*=>))"),
)
_TS = (*_JS, ("interface", r"^(\s*(?:export\s+)?)interface\s+" + NAME), ("class", r"^(\s*(?:export\s+)?)(?:const\s+)?enum\s+" + NAME), ("class", r"^(\s*(?:export\s+)?)type\s+" + NAME + r"\s*(?:<[^>]*>)?\s*="),
    ("method", r"^(\s+(?:readonly\s+)?)" + NOT_NAMED + NAME + r"\??\s*(?:<[^>()]*>\s*)?" + LIST + r"\s*:[^{};]+;\s*$"))
_JS_IMPORTS = (r"""^(\s*import\s[^"']*["'])([^"']+)""", r"""^(.*\bfrom\s+["'])([^"']+)""", r"""^(.*\brequire\(\s*["'])([^"']+)""")
_C = (("function", r"^((?:\s*(?:public|private|protected)\s*:)?\s*(?!(?:return|else|new|case|goto)\b)[A-Za-z_][\w:<>,*&\s]*?[\s*&])(?:\w+::)*([A-Za-z_]\w*)\s*\([^;]*\{?$"), ("class", r"^(\s*(?:typedef\s+)?)(?:struct|enum|union)\s+" + NAME + r"[^;()]*\{"))
_INCLUDE = (r'^(\s*#\s*include\s*[<"])([^>"]+)',)
_PY_LIST = r"^(\s*import\s+)([\w.]+(?:\s+as\s+\w+)?(?:\s*,\s*[\w.]+(?:\s+as\s+\w+)?)*)"
# further names have a namespace, as those of traits have none
_PHP_LIST = r"^(\s*use\s+)([\w\\]+(?:\s+as\s+\w+)?(?:\s*,\s*\w*(?:\\\w+)+(?:\s+as\s+\w+)?)*)"
_RUBY_CALL = r"(?:\.\s*|(?<![\w.]))" + NAME + r"\s*(?:\(|(?=\s+[\"':\w]))"

LANGUAGES = (
    Language("python", (".py", ".pyi"), (("function", r"^(\s*)(?:async\s+)?def\s+" + NAME + r"\s*\((?!:)"), ("class", r"^(\s*)class\s+" + NAME), ("constant", r"^()" + NAME + r"\s*(?::[^=]+)?=(?!=)")), (r"^(\s*from\s+)([\w.]+)\s+import", _PY_LIST), "indent", "#", lists=(_PY_LIST,)),
    Language("javascript", (".js", ".mjs", ".cjs", ".jsx"), _JS, _JS_IMPORTS),
    Language("typescript", (".ts", ".mts", ".cts"), _TS, _JS_IMPORTS),
    Language("tsx", (".tsx",), _TS, _JS_IMPORTS),
    Language("go", (".go",), (("method", r"^()func\s*\([^)]*\)\s*" + NAME), ("function", r"^()func\s+" + NAME), ("class", r"^(type\s+)" + NAME + r"\s+(?:struct|interface|func|map|\[|\w)"), ("class", r"^(\s+)" + NAME + r"\s+\S.*\stype$"), ("constant", r"^(const\s+)" + NAME), ("constant", r"^(\s+)" + NAME + r"\b.*\sconst$")), (r'^(\s*(?:import\s+)?(?:\w+\s+)?)("[^"\s]+")\s*$',)),
    Language("rust", (".rs",), (("function", r"^(\s*)(?:pub(?:\([^)]*\))?\s+)?(?:async\s+|unsafe\s+|const\s+)*fn\s+" + NAME), ("class", r"^(\s*)(?:pub(?:\([^)]*\))?\s+)?(?:struct|enum|mod|type|union)\s+" + NAME), ("interface", r"^(\s*)(?:pub\s+)?(?:unsafe\s+)?trait\s+" + NAME), ("constant", r"^(\s*)(?:pub(?:\([^)]*\))?\s+)?(?:const|static)\s+(?:mut\s+)?" + NAME + r"\s*:")), (r"^(\s*(?:pub\s+)?use\s+)([\w:]+)",)),
    Language("java", (".java",), (("class", r"^(\s*)(?:(?:public|private|protected|static|final|abstract)\s+)*(?:class|enum|record)\s+" + NAME), ("interface", r"^(\s*)(?:(?:public|private|protected|static)\s+)*interface\s+" + NAME), ("method", r"^(\s+)(?:(?:public|private|protected|static|final|synchronized|abstract)\s+)*(?!(?:return|new|else|throw)\b)(?:<[^>]*>\s*)?(?:[\w<>\[\],.?]+\s+)?" + NOT_NAMED + NAME + r"\s*" + LIST + r"[^;{}]*\{")), (r"^(\s*import\s+(?:static\s+)?)([\w.]+)",)),
    Language("c", (".c", ".h"), (*_C, ("class", r"^((?:.*[\s*])?)" + NAME + r"\s*(?:\[[^\]]*\]\s*)*;\s*typedef$")), _INCLUDE),
    Language("cpp", (".cpp", ".cc", ".cxx", ".hpp", ".hh", ".hxx"), (*_C, ("class", r"^(\s*)(?:class|namespace)\s+" + NAME + r"[^;]*\{")), _INCLUDE),
    Language("c_sharp", (".cs",), (("class", r"^(\s*)(?:(?:public|private|internal|protected|static|sealed|abstract|partial)\s+)*(?:class|struct|enum|record)\s+" + NAME), ("interface", r"^(\s*)(?:(?:public|internal)\s+)*interface\s+" + NAME), ("method", r"^(\s*)(?:(?:public|private|internal|protected|static|async|override|virtual)\s+)*(?!(?:return|new|else|using|namespace|class)\b)[\w<>\[\],.?]+\s+" + NOT_NAMED + NAME + r"\s*(?:<[^>()]*>\s*)?" + LIST + r"[^;{}]*\{")), (r"^(\s*using\s+)([\w.]+)\s*;",)),
    Language("ruby", (".rb", ".rake", ".gemspec"), (("class", r"^(\s*)(?:class|module)\s+" + NAME), ("method", r"^(\s*)def\s+self\.([A-Za-z_]\w*[?!]?)"), ("function", r"^(\s*)def\s+(?!self\.)([A-Za-z_]\w*[?!]?)")), (), "end", "#", _RUBY_CALL),
    Language("php", (".php", ".phtml"), (("class", r"^(\s*)(?:abstract\s+|final\s+)?(?:class|trait)\s+" + NAME), ("interface", r"^(\s*)interface\s+" + NAME), ("function", r"^(\s*)(?:(?:public|private|protected|static|abstract|final)\s+)*function\s+" + NAME)), (_PHP_LIST,), lists=(_PHP_LIST,)),
    Language("bash", (".sh", ".bash", ".zsh"), (("function", r"^(\s*)(?:function\s+)?([A-Za-z_][\w-]*)\s*\(\)"),), (), "brace", "#", r"^\s*([A-Za-z_][\w-]*)(?=\s|;|$)"),
    Language("kotlin", (".kt", ".kts"), (("class", r"^(\s*)(?:(?:data|open|sealed|abstract|enum)\s+)*(?:class|object|interface)\s+" + NAME), ("function", r"^(\s*)(?:(?:override|private|public|suspend|inline)\s+)*fun\s+(?:<[^>]*>\s*)?(?:\w+\.)?" + NAME)), (r"^(\s*import\s+)([\w.]+)",)),
    Language("swift", (".swift",), (("class", r"^(\s*)(?:(?:public|private|final|open)\s+)*(?:class|struct|enum|extension)\s+" + NAME), ("interface", r"^(\s*)(?:public\s+)?protocol\s+" + NAME), ("function", r"^(\s*)(?:(?:public|private|static|override|mutating)\s+)*func\s+" + NAME)), (r"^(\s*import\s+)([\w.]+)",)),
    Language("scala", (".scala", ".sc"), (("class", r"^(\s*)(?:case\s+|abstract\s+|sealed\s+)*(?:class|object)\s+" + NAME), ("interface", r"^(\s*)(?:sealed\s+)?trait\s+" + NAME), ("function", r"^(\s*)(?:override\s+|private\s+)*def\s+" + NAME)), (r"^(\s*import\s+)(\w+)",)),
    Language("lua", (".lua",), (("function", r"^(\s*)(?:local\s+)?function\s+(?:\w+[.:])?" + NAME),), (), "end", "--"),
    Language("sql", (".sql",), (("class", r"(?i)^(\s*)create\s+(?:or\s+replace\s+)?(?:table|view)\s+(?:if\s+not\s+exists\s+)?" + NAME),), (), "brace", "--", r"(?i)\bfrom\s+([A-Za-z_]\w*)"),
)

# Extensions that are known and hold no source.
NOISE = (".md", ".txt", ".json", ".yaml", ".yml", ".toml", ".lock", ".cfg", ".ini", ".gitignore")

EXTENSIONS = {e: lang.name for lang in LANGUAGES for e in lang.extensions}
