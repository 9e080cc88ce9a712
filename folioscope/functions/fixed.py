"""Fixed values that results depend on: word lists, limits, labels and patterns.

Everything here is data. The code that uses it lives next to the operator it belongs to.
"""

# Words that never become lexical terms.
STOP_WORDS = (
    "a", "an", "the", "and", "or", "to", "of", "in", "on", "for", "is", "are", "be",
    "with", "this", "that", "how", "what", "from", "by", "as", "it", "at", "into",
    "如何", "怎么", "怎样", "什么", "一下", "一个", "这个", "那个", "可以", "实现", "使用",
)

# Bilingual concept lexicon, concept name -> phrases that signal it.
CONCEPTS = {
    "database-connection": (
        "数据库连接", "连接数据库", "连数据库", "mysql connection", "database connection",
        "connect mysql", "jdbc", "datasource", "connection pool", "连接池"),
    "authentication": (
        "身份验证", "认证", "登录", "鉴权", "authentication", "authorization", "login",
        "oauth", "jwt", "token validation"),
    "http-api": (
        "接口请求", "调用接口", "网络请求", "http request", "rest api", "fetch api", "axios",
        "endpoint", "web service"),
    "error-handling": (
        "错误处理", "异常处理", "报错", "捕获异常", "error handling", "exception", "try catch",
        "fallback", "retry", "重试", "接口失败", "请求失败", "超时", "timeout"),
    "configuration": (
        "配置文件", "环境变量", "应用配置", "configuration", "environment variable", "env var",
        "settings", "properties file"),
    "file-io": (
        "读写文件", "文件读取", "文件保存", "file io", "read file", "write file", "filesystem",
        "input stream", "output stream"),
    "search": (
        "语义检索", "全文搜索", "查找内容", "semantic search", "full text search", "retrieval",
        "embedding", "vector search"),
    "concurrency": (
        "并发", "异步", "多线程", "协程", "concurrency", "async", "await", "thread pool",
        "parallel"),
    "testing": (
        "单元测试", "自动化测试", "测试用例", "unit test", "integration test", "test case",
        "assertion", "mock"),
    "logging": (
        "日志记录", "日志输出", "排查日志", "logging", "logger", "log output", "observability",
        "trace"),
    "cache": ("缓存", "缓存失效", "cache", "redis", "memoization", "ttl"),
    "deployment": (
        "部署", "发布上线", "容器化", "deployment", "docker", "container", "kubernetes",
        "ci cd"),
    "data-format": (
        "解析 json", "序列化", "数据格式", "parse json", "serialization", "deserialize", "yaml",
        "csv"),
    "dependency": (
        "安装依赖", "包管理", "依赖冲突", "dependency", "package manager", "npm install",
        "maven", "pip install"),
}

# Directories a scan never enters.
IGNORED_DIRECTORIES = (
    ".git", ".idea", ".vscode", ".folioscope", "node_modules", "target", "build", "dist",
    "out", "vendor", ".venv", "venv", "__pycache__", ".next", ".gradle",
)

# Names, prefixes, extensions and directories of credential material.
SENSITIVE_NAMES = (
    ".env", ".netrc", "_netrc", ".npmrc", ".pypirc", ".htpasswd", ".git-credentials",
    "credentials", "id_rsa", "id_dsa", "id_ecdsa", "id_ed25519",
    "secrets.yaml", "secrets.yml", "secrets.json",
)
SENSITIVE_PREFIX = ".env."
SENSITIVE_EXTENSIONS = (
    "pem", "key", "p12", "pfx", "jks", "keystore", "kdbx", "ppk", "asc", "gpg",
)
SENSITIVE_DIRECTORIES = (".ssh", ".gnupg", ".aws", ".azure", ".kube")

# What each reader takes, its version and its size limit in bytes.
TEXT_EXTENSIONS = (
    "md", "markdown", "txt", "rst", "adoc", "java", "kt", "kts", "py", "js", "jsx",
    "ts", "tsx", "go", "rs", "c", "h", "cpp", "hpp", "cs", "php", "rb", "swift",
    "scala", "sql", "sh", "bash", "ps1", "bat", "cmd", "css", "scss", "less", "xml",
    "json", "jsonl", "yaml", "yml", "toml", "ini", "properties", "conf", "vue", "svelte",
    "gradle", "dockerfile",
    "csv", "tsv", "proto", "graphql", "gql", "tf", "tfvars", "hcl",
    "lua", "r", "pl", "pm", "ex", "exs", "erl", "dart", "groovy",
)
TEXT_FILE_NAMES = (
    "dockerfile", "makefile", "readme", "license",
    "gemfile", "rakefile", "procfile", "vagrantfile", "justfile", "taskfile",
)
HTML_EXTENSIONS = ("html", "htm")
TEXT_MAX_BYTES = 2 * 1024 * 1024
HTML_MAX_BYTES = 5 * 1024 * 1024
OFFICE_MAX_BYTES = 32 * 1024 * 1024
TEXT_READER = ("plain-text", 2, TEXT_MAX_BYTES)
HTML_READER = ("html-main-content", 1, HTML_MAX_BYTES)

# HTML elements that are dropped, and elements that carry text.
HTML_DROPPED = ("script", "style", "noscript", "svg", "canvas", "nav", "footer", "aside", "form")
HTML_HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
HTML_TEXT_BLOCKS = ("p", "li", "pre", "blockquote", "dt", "dd", "th", "td")
HTML_DEFAULT_TITLE = "正文"
HTML_SECTION_PREFIX = "章节："
HTML_RANGE_LABEL = "段落"

# Extensions chunked as code, and the smaller set the feature score calls code.
CODE_EXTENSIONS = (
    "java", "kt", "kts", "py", "js", "jsx", "ts", "tsx", "go", "rs", "c", "h",
    "cpp", "hpp", "cs", "php", "rb", "swift", "scala", "sql", "sh", "bash", "ps1",
    "bat", "cmd", "css", "scss", "vue", "svelte",
)
CODE_CHUNK_EXTENSIONS = CODE_EXTENSIONS + (
    "lua", "r", "pl", "pm", "ex", "exs", "erl", "dart", "groovy",
    "proto", "graphql", "gql", "tf", "tfvars", "hcl",
)

# Patterns that mark the start of a code symbol.
DECLARATION_PATTERN = (
    r"(?i)^\s*(?:(?:public|protected|private|static|final|abstract|synchronized|native|override"
    r"|open|internal|export|default|async)\s+)*"
    r"(?:class|interface|record|enum|struct|trait|object|def|function|fun|fn|func|type)\s+"
    r"([A-Za-z_$][\w$]*)"
)
ARROW_PATTERN = r"^\s*(?:export\s+)?(?:const|let|var)\s+([A-Za-z_$][\w$]*)\s*=.*=>"
METHOD_PATTERN = (
    r"^\s*(?:(?:public|protected|private|static|final|abstract|synchronized|override|open"
    r"|internal|async)\s+)*"
    r"(?:[A-Za-z_$][\w$<>?,.\[\] ]+\s+)?([A-Za-z_$][\w$]*)\s*\([^;]*\)\s*"
    r"(?:\{|throws\b.*|:)?\s*$"
)
NOT_A_METHOD = ("if", "for", "while", "switch", "catch", "return", "new")
FILE_HEAD_SYMBOL = "文件头"
SYMBOL_PREFIX = "符号："
LEADING_MARKS = ("@", "//", "#", "*", "/*", '"')
MAX_LEADING_LINES = 4

# Query analysis patterns.
CODE_INTENT_PATTERN = (
    "(?i)(代码|源码|实现|定义|类|方法|函数|接口|调用链|code|source|implementation|defined"
    "|definition|class|method|function)"
)
LOCATION_INTENT_PATTERN = (
    "(?i)(在哪|哪里|哪儿|位置|哪个文件|什么文件|怎么找到|帮我找|定位|where|which file|location"
    "|find|located)"
)
BOILERPLATE_PATTERN = (
    r"(?i)(请帮我找|帮我找|请问|请帮我|帮我|告诉我|我想知道|具体的?|在哪(里|儿)?|哪个文件|什么文件|怎么找到"
    r"|where\s+(is|are|can\s+i\s+find)|which\s+file|location\s+of"
    r"|find\s+(the\s+)?(code|implementation)|source\s+code)"
)
QUERY_PUNCTUATION_PATTERN = "[？?，,：:]+"
SUBJECT_NOISE_PATTERN = (
    r"(相关|对应|这个|那个|该)\s*(的)?\s*(代码|源码|实现|定义|位置|文件)"
    r"|\s*(代码|源码|实现|定义|位置)\s*$"
)
FACET_BOUNDARY_PATTERN = (
    r"(?i)[？?。；;！!]+|[，,]?\s*(?:以及|还有|另外|顺便|同时)|\s+(?:and also|as well as)\s+"
)
FACET_EDGE_PATTERN = r"^[\s、，,：:；;。！!？?]+|[\s、，,：:；;。！!？?]+$"
REFERENTIAL_PATTERN = (
    r"(?i)(它|他|她|这个|那个|这些|那些|此处|这里|那里|上面|前面|刚才|该功能|该方法|该类|该配置|该文件"
    r"|\bit\b|\bthis\b|\bthat\b|\bthese\b|\bthose\b|\bthere\b|\bthe same\b|\babove\b)"
)
ALL_EXTENSION_FILTERS = ("全部", "all", "*")

# Texts that explain a hit.
REASON_DECLARATION = "BM25 代码定义匹配"
REASON_METADATA = "BM25 文件元数据匹配"
REASON_LEXICAL = "BM25 词法召回"
REASON_DENSE = "向量语义召回"
REASON_FUSED = "BM25 + 向量 RRF 融合"
RERANKER_NAME = "local-feature-reranker-v1"
REASON_FACET_PREFIX = "子查询交错融合 · "
REASON_CONTEXT_SUFFIX = " · MMR 去重与父章节邻接扩展"

# Separators inside source locations and identities.
LOCATION_SEPARATOR = " · "
LOCATION_SPAN = " — "
IDENTITY_SEPARATOR = "\u0000"

# Format and rule versions.
CHUNKING_VERSION = 3
INDEX_FORMAT_VERSION = 5

# Index status names, freshness state names, file state names.
INDEX_STATUSES = ("EMPTY", "READY", "DIRTY", "BUILDING", "FAILED", "INCOMPATIBLE")
FRESHNESS_STATES = ("STOPPED", "VERIFYING", "VERIFIED", "CHANGED", "UNAVAILABLE")
FILE_STATES = (
    "INDEXED", "MODIFIED", "NOT_INDEXED", "DELETED", "OVERSIZED", "UNSUPPORTED", "IGNORED",
    "FOLDER",
)

# Tag that wraps a model's reasoning.
THINK_OPEN = "<think>"
THINK_CLOSE = "</think>"

# Redaction of diagnostic texts.
BEARER_PATTERN = r"(?i)bearer\s+\S+"
API_KEY_PATTERN = r"(?i)(api[_ -]?key|authorization)\s*[:=]\s*\S+"
SENSITIVE_ATTRIBUTE_PARTS = ("key", "authorization", "prompt", "content", "chunktext", "body")
REDACTED = "[REDACTED]"

# Passages inside a hit. Characters of a span; lines of a window, and lines from one window to
# the next; least similarity; what length takes off a span's similarity, and at most.
SPAN_SHORTEST, SPAN_LONGEST = 8, 700
SPAN_WINDOW, SPAN_STRIDE = 4, 2
SPAN_THRESHOLD = 0.18
SPAN_PENALTY, SPAN_PENALTY_LENGTH, SPAN_PENALTY_MOST = 0.018, 90.0, 0.055
