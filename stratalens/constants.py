"""Fixed values that results depend on: word lists, thresholds, patterns. Data only."""

# Language by base name, then by lower-cased extension.
BASENAMES = {".gitignore": "gitignore", ".dockerignore": "gitignore", "Makefile": "make", "makefile": "make", "Dockerfile": "dockerfile", "CMakeLists.txt": "cmake", ".env": "ini", "go.mod": "gomod"}
BASENAME_PREFIXES = {"Dockerfile.": "dockerfile", ".env.": "ini"}
EXTENSIONS = {
    "rust": "rs", "python": "py pyi", "typescript": "ts tsx", "javascript": "js jsx mjs cjs", "go": "go", "bash": "sh bash", "c": "c h", "cpp": "cpp cc cxx hpp hh hxx", "java": "java", "ruby": "rb",
    "php": "php", "swift": "swift", "kotlin": "kt kts", "c_sharp": "cs", "lua": "lua", "perl": "pl pm", "zig": "zig", "toml": "toml", "json": "json", "yaml": "yaml yml", "html": "html htm", "css": "css",
    "sql": "sql", "dockerfile": "dockerfile", "protobuf": "proto", "solidity": "sol", "nix": "nix", "r": "r", "scala": "scala", "haskell": "hs", "ocaml": "ml mli", "elixir": "ex exs", "clojure": "clj",
    "dart": "dart", "hcl": "hcl tf tfvars", "make": "make mk makefile", "cmake": "cmake", "markdown": "md markdown", "latex": "tex", "graphql": "graphql gql", "scss": "scss sass", "jinja2": "j2 jinja jinja2",
    "xml": "xml xsl xslt svg plist csproj pom", "ini": "ini cfg conf service desktop editorconfig", "diff": "diff patch",
}

# What a scan leaves out.
SKIP_DIRS = ".git .zig-cache zig-out node_modules target .mypy_cache __pycache__ .tox .pytest_cache vendor dist build .next .nuxt .svelte-kit .parcel-cache .turbo coverage .nyc_output .cache venv site-packages Pods _build elm-stuff bower_components .terraform mkosi.tools mkosi.cache mkosi.output .mkosi".split()
SKIP_FRAGMENTS = ["go/pkg/mod", "go/pkg/sumdb", "go/pkg/cache"]
SKIP_EXTENSIONS = ".exe .dll .so .dylib .o .a .lib .pyc .pyo .class .jar .war .wasm .min.js .min.css .png .jpg .jpeg .gif .bmp .ico .svg .mp3 .mp4 .avi .mov .webm .zip .tar .gz .bz2 .xz .rar .7z .pdf .doc .docx .xls .xlsx .sqlite .db .lock".split()
HIDDEN_ALLOWED = [".gitignore", ".env", ".env.example"]
MAX_FILES, MAX_BYTES, MAX_FILE, POSTING_BYTES, CHANGE_LOG, ANSWER_ROWS = 100_000, 1 << 30, 10 << 20, 512 << 10, 1000, 10_000

# Words end at these characters.
DELIMITERS = " \t\n\r(){}[];:.,\"'<>?!=+-*/&|^%~#@`"

TAG_KINDS = {"interface": "class", "type": "type_alias", "implementation": "impl", "use": "import"} | {k: k for k in "function method class struct enum macro module constant variable impl union trait test import".split()}

# Python modules that are never files of the workspace.
PYTHON_STDLIB = "os sys re json time datetime math random collections itertools functools typing pathlib subprocess threading asyncio logging unittest io abc enum dataclasses contextlib copy shutil tempfile hashlib base64 struct socket http urllib csv sqlite3 argparse".split()

# Security rules: (text, rule, severity, any case).
SECURITY = [
    ("-----BEGIN", "private_key_block", "critical", False), ("sk_live_", "stripe_live_key", "critical", False),
    ('password = "', "hardcoded_secret", "critical", True), ('secret = "', "hardcoded_secret", "critical", True), ('api_key = "', "hardcoded_secret", "critical", True),
    ("ghp_", "github_token", "high", False), ("xoxb-", "slack_token", "high", False), ("AIza", "google_api_key", "high", False), ("eval(", "eval_usage", "high", False),
    ("exec(", "command_injection", "high", False), ("os.system(", "command_injection", "high", False), ("subprocess.call(", "command_injection", "high", False),
    ("cors::any()", "cors_wildcard", "high", False), ("tx.origin", "solidity_tx_origin_auth", "high", False), ("selfdestruct(", "solidity_selfdestruct", "high", False),
    ("suicide(", "solidity_selfdestruct", "high", False), ("delegatecall(", "solidity_delegatecall", "high", False), ("innerHTML", "xss_risk", "medium", False),
    ("dangerouslySetInnerHTML", "xss_risk", "medium", False), (".call{value", "solidity_low_level_call", "medium", False), ("blockhash(", "solidity_weak_randomness", "medium", False),
    ("unsafe {", "unsafe_block", "low", False), ("block.timestamp", "solidity_timestamp_dependence", "low", False), ("encodePacked(", "solidity_hash_collision_risk", "low", True),
]
SECURITY_SKIP = ["/analysis/", ".example", ".sample", "/test", "_test.", ".test.", "/spec"]
SECRET_NOT = ["example", "your_", "your-", "changeme", "placeholder", "xxxx", "dummy", "redacted", "<", "..."]
SECRET_CRITICAL = ["private_key", "privkey", "mnemonic", "seed_phrase", "secret", "password", "passwd"]
SECRET_HIGH = ["api_key", "apikey", "access_key", "auth_token", "credential"]

DEAD_SKIP_KINDS = ["test", "impl", "import", "module"]
DEAD_SKIP_NAMES = "main new default init deinit drop clone fmt from into try_from try_into as_ref as_mut serialize deserialize build run start stop".split()
PANICS = [(".unwrap()", "Unwrap"), (".expect(", "Expect"), ("panic!(", "Panic"), ("unreachable!(", "Panic"), ("todo!(", "Panic")]
TEST_MARKS = ["#[test]", "#[cfg(test)]", "#[tokio::test]"]
LAYERS = [
    ("presentation", "gateway api routes handlers views pages components".split()),
    ("application", "services controllers commands use_cases".split()),
    ("domain", "models domain entities types".split()),
    ("infrastructure", "db nats redis storage persistence adapters".split()),
]
ROUTE_PATTERNS = ['.get("', '.post("', '.put("', '.delete("', '.patch("', '.route("', '.GET("', '.POST("', '.PUT("', '.DELETE("', 'HandleFunc("', 'Handle("', 'r.Get("', 'r.Post("', 'r.Put("', 'r.Delete("']
CALL_PATTERNS = ['fetch("', "fetch(`", "axios.get(", "axios.post(", "axios.put(", "axios.delete(", "http.get(", "http.post(", "http.put(", "http.delete("]
TYPE_PAIRS = [("String", "string"), ("str", "string"), ("&str", "string"), *[(x, "number") for x in "i32 i64 u32 u64 f32 f64 usize int".split()], ("int", "i64"), ("bool", "boolean"), ("Vec<", "Array<"), ("Vec<", "[]")]
ORM_HINTS = ["#[table_name", "#[diesel(", "tableName", "@Entity", "db.Model", "models.Model", "@Table("]
CREDENTIAL_WORDS = "password secret api_key token private_key access_key auth_token credential".split()
LITERAL_SKIP = ["node_modules", "/vendor/", "/target/", "/dist/", "/build/", "/.git/", "/tests/", "/test/", "_test.", ".test.ts", ".test.tsx", ".spec.ts", ".spec.tsx", ".md", ".markdown", "/migrations/", "/fixtures/"]
LITERAL_SKIP_LANGUAGES = ["unknown", "json", "xml", "diff", "gitcommit", "gitignore"]
SCHEMES = "https http wss ws postgres postgresql mongodb redis amqp grpc".split()
MAGIC_PORTS = "5432 6379 3306 5672 9092 27017 4222".split()
ABS_PATHS = ['"/home/', '"/usr/', '"/var/', '"/opt/', '"/etc/', "'/home/", "'/usr/", "'/etc/"]
ENTRY_SUFFIXES = ["main.rs", "/main.go", "main.py", "__main__.py", "index.ts", "index.tsx", "main.zig", "lib.rs", "mod.rs", "Cargo.toml", "package.json", "tsconfig.json", ".toml", ".yaml", ".yml", ".sql", ".md"]
DUPLICATE_KINDS = "function class struct enum trait type_alias union".split()
DUPLICATE_SKIP_LANGUAGES = "html css scss json yaml toml ini markdown sql dockerfile make xml jinja2 gitignore diff hcl".split()
DUPLICATE_SKIP_NAMES = "new default init deinit drop clone main build from into with next value name run start stop close open get set handle process create update delete list format toString equals hashCode serialize deserialize".split()
CLONE_COMMENT = ["//", "#", "--", "/*", "*", ";;"]
CLONE_LINES = 6
GENERATED = ["generated/", ".pb.go", ".gen.", "_pb2.py", "/gen/", ".g.dart", "/node_modules/", "/vendor/", ".lock"]
CONTROL_FLOW = r"\b(if|for|while|switch|case|catch|elif|when|loop|&&|\|\||\?)\b|\?"

# Literals that a change of a file should mind.
PLAN_PORTS = "5432 6379 3306 27017 4222 9092".split()
PLAN_PATHS = ['"/home/', '"/etc/', '"/var/', '"/opt/', '"/usr/']

# Command classifier.
SEARCH_COMMANDS = {"grep", "egrep", "fgrep", "rg", "ag", "ack"}
READ_COMMANDS = {"cat", "head", "tail", "less", "more", "bat", "sed"}
VALUE_FLAGS = {"-A", "-B", "-C", "-m", "-f", "--include", "--exclude", "--exclude-dir"}
SHELL_OPERATORS = {"|", "||", "&&", ";", ">", "<", ">>"}
IDENTIFIER = r"^[A-Za-z_][A-Za-z0-9_]{2,}$"
SOURCE_EXTENSION = r"\.(ts|tsx|js|jsx|mjs|cjs|py|go|rs|zig|c|h|cc|cpp|hpp|hh|java|kt|kts|rb|swift|dart|scala|ex|exs|erl|php|cs|lua|sol|proto|m|mm|sh|bash)$"
NOISE = r"node_modules|/\.git/|/proc/|/var/log|/dist/|/build/|/vendor/|/target/|/zig-out/|\.min\.|\.lock$|\.log$|\.json$|\.jsonl$|\.ya?ml$|\.toml$|\.ini$|\.env|\.csv$|\.tsv$|\.txt$|\.md$|\.pem$|\.sum$"
