"""Fixed values that results depend on."""

# Words that are never keywords of a question.
KEYWORD_STOPS = "what where how does the is are can in of to for with and or a an".split()
# Words that are never key terms of a graph search.
TERM_STOPS = "what where how when why who which does do is are was were the a an and or but in on at to for of with by this that".split()
# Words that carry no weight in relevance scoring.
FEATURE_STOPS = (
    "the a an and or but in on at to for of with by from as is was are were been be have has had do does did will would could should may might must "
    "shall can need what where when how why which who whom whose"
).split()
TECHNICAL_TERMS = (
    "function method class module package import export interface implementation algorithm data structure api service controller model view component "
    "library framework database query request response error exception handler middleware authentication authorization validation configuration "
    "initialization constructor destructor"
).split()
# Weights of path parts and of file endings.
PATH_WEIGHTS = {
    "src": 1.2, "lib": 1.2, "core": 1.3, "main": 1.1, "app": 1.1, "test": 0.7, "tests": 0.7, "spec": 0.7, "example": 0.6, "examples": 0.6,
    "doc": 0.5, "docs": 0.5, "vendor": 0.4, "node_modules": 0.3, "dist": 0.3, "build": 0.3,
}
EXTENSION_WEIGHTS = {x: 1.0 for x in ".py .js .ts .java .go .rs .cpp .c .cs .rb .php .swift .kt .scala".split()} | {
    ".md": 0.6, ".txt": 0.5, ".json": 0.7, ".yaml": 0.7, ".yml": 0.7, ".xml": 0.6, ".config": 0.7, ".ini": 0.6,
}
BOOSTED_ENDINGS = (".py", ".js", ".ts", ".java", ".go")
TEST_ENDINGS = ("_test.py", ".test.js", "Test.java")
# What searches and graphs leave out.
SEARCH_IGNORES = (
    ".git .svn .hg node_modules __pycache__ *.pyc *.pyo *.so *.dylib *.dll *.exe dist build target .venv venv env .tox .pytest_cache .mypy_cache "
    "*.egg-info coverage .coverage htmlcov .idea .vscode"
).split()
GRAPH_IGNORES = (
    "__pycache__ .git node_modules dist build .pytest_cache .mypy_cache target .venv venv site-packages .env env .tox eggs *.egg-info .DS_Store Thumbs.db "
    ".idea .vscode .coverage"
).split()
# Names of file types that searches accept beside endings.
FILE_TYPES = {
    "python": "py", "js": "js", "ts": "ts", "java": "java", "go": "go", "rust": "rs", "cpp": "cpp", "c": "c", "csharp": "cs", "ruby": "rb", "php": "php",
    "swift": "swift", "kotlin": "kt",
}
# What dependency graphs are made from, and what is never analysed.
GRAPH_ENDINGS = (".py", ".java", ".js", ".ts")
BINARY_ENDINGS = (".pyc", ".pyo", ".so", ".dylib", ".dll", ".exe", ".bin")
# Languages by file ending: for display, and for deciding which are in use.
LANGUAGES = {
    ".py": "python", ".js": "javascript", ".jsx": "javascript", ".ts": "typescript", ".tsx": "typescript", ".java": "java", ".go": "go", ".rs": "rust",
    ".cpp": "cpp", ".cc": "cpp", ".hpp": "cpp", ".c": "c", ".h": "c", ".rb": "ruby", ".php": "php", ".cs": "csharp", ".swift": "swift", ".kt": "kotlin",
    ".scala": "scala", ".r": "r", ".m": "objective-c", ".mm": "objective-c++",
}
ACTIVE_LANGUAGES = {
    ".py": "python", ".js": "javascript", ".jsx": "javascript", ".ts": "typescript", ".tsx": "typescript", ".java": "java", ".go": "go", ".rs": "rust",
    ".cpp": "cpp", ".cc": "cpp", ".cxx": "cpp", ".c": "c", ".h": "c",
}
PARSED_LANGUAGES = ("python", "java")
# Modules that are not part of a project.
STANDARD_MODULES = (
    "os sys json time datetime collections typing pathlib re math random itertools functools hashlib uuid logging argparse subprocess threading "
    "multiprocessing urllib http socket ssl email csv xml html"
).split()
COMMON_PACKAGES = "numpy pandas matplotlib requests flask django sqlalchemy pytest click rich pydantic fastapi aiohttp asyncio setuptools pip wheel".split()
JAVA_PLATFORM = "java. javax. javafx. jdk. com.sun. sun. org.w3c. org.xml. org.ietf. org.omg.".split()
JAVA_COMMON = (
    "org.springframework. org.apache. org.junit. org.mockito. org.slf4j. org.hibernate. com.google. com.fasterxml. org.jetbrains. io.github. org.testng."
).split()
JAVA_NO_CALLS = "if for while switch catch throw return".split()
JS_NO_CALLS = JAVA_NO_CALLS + ["function"]
# Build files that tell a project's type, first one wins.
MANIFESTS = {
    "package.json": "Node.js", "setup.py": "Python", "pyproject.toml": "Python", "Cargo.toml": "Rust", "go.mod": "Go", "pom.xml": "Java",
    "build.gradle": "Java", "composer.json": "PHP", "Gemfile": "Ruby",
}
METADATA_MANIFESTS = {
    "package.json": ("node", "javascript"), "setup.py": ("python", "python"), "pyproject.toml": ("python", "python"), "pom.xml": ("maven", "java"),
    "go.mod": ("go", "go"), "Cargo.toml": ("rust", "rust"),
}
MANIFEST_LANGUAGES = {
    "package.json": "JavaScript", "setup.py": "Python", "pyproject.toml": "Python", "Cargo.toml": "Rust", "go.mod": "Go", "pom.xml": "Java",
    "build.gradle": "Java", "composer.json": "PHP", "Gemfile": "Ruby",
}
ENDING_TYPES = ((("py",), "Python"), (("js", "ts"), "JavaScript"), (("java",), "Java"), (("go",), "Go"))
TEST_FOLDERS = ("test", "tests", "spec", "__tests__")
NODE_TYPES = "file function class variable import call parameter return_type".split()
EDGE_TYPES = "contains calls imports inherits references defines uses implements depends_on".split()
CHANGE_WORDS = ("change", "modify", "update", "fix")
# Patterns.
IDENTIFIER = "[A-Za-z_][A-Za-z0-9_]*"
QUOTED = "[\"']([^\"']+)[\"']"
DOTTED = rf"{IDENTIFIER}(?:\.{IDENTIFIER})*"
PY_FROM, PY_IMPORT = r"from\s+([\w\.]+)\s+import", r"import\s+([\w\.]+)"
JS_FROM = "import.*from\\s+[\"']([^\"']+)[\"']"
JAVA_IMPORT, JAVA_STATIC = rf"import\s+({DOTTED})\s*;", rf"import\s+static\s+({DOTTED})\s*;"
GRAPH_JAVA_IMPORT, JAVA_CALL = rf"import\s+(?:static\s+)?({DOTTED})\s*;", rf"({IDENTIFIER})\s*\("
GRAPH_JS_IMPORTS = ("import\\s+.*?\\s+from\\s+[\"']([^\"']+)[\"']", "import\\s+[\"']([^\"']+)[\"']", "require\\s*\\(\\s*[\"']([^\"']+)[\"']\\s*\\)")
JS_CALL = r"([a-zA-Z_$][a-zA-Z0-9_$]*)\s*\("
GREP_LINE = r"^(.+?):(\d+):(.*)$"

#: Tree patterns of the parsed languages.
TREE_PATTERNS = {
    "python": {
        "functions": "(function_definition name: (identifier) @function.name parameters: (parameters) @function.params body: (block) @function.body) @function.def",
        "classes": "(class_definition name: (identifier) @class.name body: (block) @class.body) @class.def",
        "docstrings": """
            (module . (comment)* . (expression_statement (string)) @module_doc_str)
            (class_definition body: (block . (expression_statement (string)) @class_doc_str))
            (function_definition body: (block . (expression_statement (string)) @function_doc_str))""",
    },
    "java": {
        "functions": """
            (method_declaration name: (identifier) @function.name parameters: (formal_parameters) @function.params body: (block) @function.body) @function.def
            (constructor_declaration name: (identifier) @function.name parameters: (formal_parameters) @function.params body: (constructor_body) @function.body) @function.def""",
        "classes": """
            (class_declaration name: (identifier) @class.name body: (class_body) @class.body) @class.def
            (interface_declaration name: (identifier) @class.name body: (interface_body) @class.body) @class.def""",
        "javadoc": "(block_comment) @javadoc",
    },
}
