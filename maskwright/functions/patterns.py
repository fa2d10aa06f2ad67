r"""Patterns of the detectors, as regular expressions that Python and Java read alike.

Group 1 is what precedes a value and group 2 the value where a detector masks only a part; other patterns have no
groups. Classes are ASCII.
"""

from __future__ import annotations

# What the detectors look for.
DATABASE_URI = r"""(?i)\b(?:postgres|postgresql|mysql|mssql|mongodb|sqlite|redis)://[^\s"']+"""
URL = r"""(?i)(?:https?|ftp|sftp)://[^\s"']+"""
CONNECTION_STRING = r"(?i)\b(?:Server|Data Source|Host|User ID|Database)\s*=[^;]+(?:;[^;]+=[^;]+)+\b"
CONN_PASSWORD = r"""(?i)((?:Password|Pwd|Secret)\s*=\s*)([^;\s"]+)"""
CONN_USER = r"""(?i)((?:User ID|Uid|Username)\s*=\s*)([^;\s"]+)"""
CONN_HOST = r"""(?i)((?:Server|Data Source|Host)\s*=\s*)([^;\s"]+)"""
CONN_PORT = r"(?i)(\b(?:Port)\s*=\s*)([0-9]+)"
CONN_DATABASE = r"""(?i)((?:Database|Initial Catalog)\s*=\s*)([^;\s"]+)"""
CLOUD = r"""(?i)(\b(?:AWS_SECRET_ACCESS_KEY|AZURE_CLIENT_SECRET|GOOGLE_APPLICATION_CREDENTIALS)\s*=\s*)([^"'\s]+)\b"""
AUTH_HEADER = r"(?im)((?:^(?:Authorization|X-API-Key)\s*:\s*|\bBearer\s+)(?:(?:Bearer|Basic|Token)\s+)?)([^\s]+)"
JSON_SECRET = r"""(?i)((?:["'](?:password|pwd|secret|token|api[_-]?key)["']\s*:\s*["']?))([^"',\r\n{}]+)["']?"""
IPV4 = r"\b(?:\d{1,3}\.){3}\d{1,3}\b"
IPV6 = r"(?<![a-zA-Z0-9])(?:[A-Fa-f0-9]{0,4}:){2,7}[A-Fa-f0-9]{0,4}(?![a-zA-Z0-9])"
API_KEY = r"\b(?:AKIA[0-9A-Z]{16}|sk-(?:live|test)-[a-zA-Z0-9]{24,}|ghp_[a-zA-Z0-9]{36}|ya29\.[a-zA-Z0-9_-]+|AIza[a-zA-Z0-9_-]{35})\b"
JWT = r"ey[a-zA-Z0-9_-]+\.[a-zA-Z0-9_-]+\.[a-zA-Z0-9_-]+"
PRIVATE_KEY = r"(?s)-----BEGIN (?:[A-Z]+ )?PRIVATE KEY-----.*?-----END (?:[A-Z]+ )?PRIVATE KEY-----"
ENV_VAR = (
    r"(?im)(^(?:export\s+)?[A-Z0-9_]*(?:PASSWORD|SECRET|TOKEN|KEY|DATABASE_URL|DB_URL|DATABASE_URI|DB_URI|REDIS_URL|MONGODB_URI|CONNECTION_STRING)[A-Z0-9_]*"
    r"""\s*=\s*"?)([^"\s]+)"?"""
)
HASH_CONTEXT = r"(?i)(\b(?:md5|sha1|sha256|sha512|checksum|hash)\s*[:=]\s*)([a-fA-F0-9]{32,128})\b"
HASH_ID = r"\b(?:[0-9a-fA-F]{32}|[0-9a-fA-F]{40}|[0-9a-fA-F]{64}|[0-9a-fA-F]{128})\b"
HOSTNAME = r"\b(?:[a-zA-Z0-9](?:[a-zA-Z0-9-]{0,61}[a-zA-Z0-9])?\.)+[a-zA-Z]{2,}\b"
EMAIL = r"\b[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}\b"
PHONE = r"(?<!-)\b\+?\d{1,3}?[-.\s]?\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}\b"
KEY_VALUE = r"""(?i)(\b(?:password|pwd|secret|token|key)\b\s*[:=]\s*)([^\s"';]+)"""

#: Scheme, user part, host, port and path of a match; a port the text does not name is the scheme's default.
URI_PARTS = r"(?i)^([a-z][a-z0-9+.-]*)://(?:([^/?#]*)@)?(\[[^\]]*\]|[^:/?#]*)(?::(\d+))?(/[^?#]*)?"
DEFAULT_PORTS = {"http": 80, "https": 443, "ftp": 21}

VALID_IPV4 = r"^(?:(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])$"
PRIVATE_IPV4 = r"^(?:10\.|192\.168\.|172\.(?:1[6-9]|2[0-9]|3[01])\.)"
IPV6_FULL = r"^[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){7}$"
IPV6_SHORT = r"^(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4})*)?::(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4})*)?$"
