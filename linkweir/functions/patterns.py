"""Fixed patterns in Java's dialect. Flags (?iU): case-insensitive, with Unicode classes. The rule for bare addresses is ``url_matcher``."""

LATEX_URL = r"\\url\{([^}]+)\}"
LATEX_URLADDR = r"\\urladdr\{([^}]+)\}"
MARKDOWN_LINK = r"(?iU)!?\[(?:[^\[\]]*)\]\((https?://[^\s)]+)\)"
HTML_ATTRIBUTE = r"""(?iU)(?:href|src|action|data-href|data-src)\s*=\s*["']?(https?://[^\s"'<>)]+)["']?"""
BARE = r"""(?iU)(?<![(\["'])https?://(?:[a-zA-Z0-9\-._~:/?#\[\]@!$&'()*+,;=%]+)"""
STRICT = r"(?iU)\b(?:https?://|www\.)[A-Za-z0-9\-._~:/?#\[\]@!$&'()*+,;=%]+"
RAW_BYTES = r"""(?i)(https?://[^\s<>()"']+)"""
#: Metadata hosts and paths that are no citations, in lower case.
NOISE = r"ns\.adobe\.com|adobe\.com|w3\.org|purl\.org|xml\.org|schemas\.microsoft\.com|xmlns|/xap/|/rdf/"
#: Of a converter that names itself in each file.
CONVERTER_URL = "https://github.com/kermitt2/grobid"
MISSING_STYLE = r"File `([^']+\.sty)' not found"
