"""Detection, policy and masking of one text in plain Python; the operators run it on Arrow batches.

Spark has no expression for the places of a pattern's matches: prefix sums over the pieces between them took most of the
time and planning of the nineteen detectors. Here every step is linear in the text and its findings.

A finding is (category, start, length, confidence, severity, value_start, value_length, source, ord); a span of a plan is
(start, length, mode).
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Callable, Iterable, Iterator
from functools import cached_property, lru_cache

from maskwright.functions import patterns as P
from maskwright.settings import Settings

LOW, MEDIUM, HIGH, CRITICAL = range(4)
PRESERVE, PARTIAL, FULL = 0, 1, 2
LEAST_CONFIDENCE = 0.70

# How categories are treated.
CREDENTIALS = frozenset(("PasswordLike", "DatabaseCredential", "ApiKey", "PrivateKey", "AuthHeader", "TokenLike", "JsonSecret", "EnvironmentVariable", "CloudCredential", "HashContext"))
PARTIAL_CREDENTIALS = frozenset(("PasswordLike",))
SENSITIVE_CONTEXT = frozenset(("Email", "Phone", "PrivateIp", "PublicIp", "Ipv6", "Hostname", "Port", "DatabaseName", "HashId", "SecretLike"))
FULL_CONTEXT = frozenset(("Port", "DatabaseName", "HashId", "SecretLike"))

Finding = tuple
Span = tuple[int, int, int]


@lru_cache(256)
def compiled(pattern: str) -> re.Pattern[str]:
    return re.compile(pattern, re.A)


def valid_ipv4(s: str) -> bool:
    return bool(compiled(P.VALID_IPV4).search(s))


def private_ipv4(s: str) -> bool:
    return bool(compiled(P.PRIVATE_IPV4).search(s))


def valid_ipv6(s: str) -> bool:
    """Eight groups, or at most seven around one ``::``."""
    return bool(compiled(P.IPV6_FULL).search(s)) or bool(compiled(P.IPV6_SHORT).search(s)) and sum(g != "" for g in s.split(":")) <= 7


def plain(category: str, start: int, length: int, confidence: float, severity: int, order: int, source: str = "Regex") -> Finding:
    return category, start, length, confidence, severity, None, None, source, order


class Text:
    """A text and its lower case, in which the words are looked for that every match of a detector holds."""

    def __init__(self, text: str):
        self.text, self.low = text, text.lower()

    def has(self, *words: str) -> bool:
        return any(w in self.low for w in words)

    @cached_property
    def digit(self) -> bool:
        return bool(compiled(r"\d").search(self.text))

    @cached_property
    def long_hex(self) -> bool:
        return bool(compiled("[0-9a-f]{32}").search(self.low))


def _each(t: Text, pattern: str, category: str, confidence: float, severity: int, order: int, keep: Callable[[re.Match[str]], bool] | None = None) -> Iterator[Finding]:
    """A finding for each match; of a pattern with groups, the second is the value."""
    rx = compiled(pattern)
    for m in rx.finditer(t.text):
        if keep is None or keep(m):
            value = (m.end(1), len(m[2])) if rx.groups else (None, None)
            yield category, m.start(), m.end() - m.start(), confidence, severity, *value, "Regex", order


def _ip_or_host(host: str, at: int, conf_ip: float, conf_host: float, order: int, s: Settings) -> Iterator[Finding]:
    if valid_ipv4(host):
        private = private_ipv4(host)
        if s.mask_private_ip if private else s.mask_public_ip:
            yield plain("PrivateIp" if private else "PublicIp", at, len(host), conf_ip, LOW, order)
    elif valid_ipv6(re.sub(r"^\[|\]$", "", host)):
        if s.mask_public_ip:
            yield plain("Ipv6", at, len(host), conf_ip, LOW, order)
    elif s.mask_domains and host:
        yield plain("Hostname", at, len(host), conf_host, MEDIUM, order)


def _uris(t: Text, pattern: str, category: str, confidence: float, password: str, order: int, s: Settings) -> Iterator[Finding]:
    """A finding for the whole address, its credentials, host, port and first path segment.

    Parts are located by their first occurrence in the match. A scheme's default port counts as named by the text.
    """
    if "://" not in t.text:
        return
    for m in compiled(pattern).finditer(t.text):
        u, at = m[0], m.start()
        cut = compiled(P.URI_PARTS).search(u)
        scheme, _, host, port, path = (x or "" for x in cut.groups()) if cut else ("",) * 5
        port = re.sub("^0+(?=.)", "", port) if port else str(P.DEFAULT_PORTS.get(scheme.lower(), ""))
        segment = re.search("^/+([^/]+)", path)
        yield plain(category, at, len(u), confidence, LOW, order)
        if s.mask_passwords:
            head, stop = u.index("://") + 3, u.find("@")
            if stop > head:
                colon = u.find(":", head, stop)
                yield plain("Username", at + head, (stop if colon < 0 else colon) - head, 0.90, MEDIUM, order)
                if colon >= 0:
                    yield plain(password, at + colon + 1, stop - colon - 1, 0.99, CRITICAL, order)
        if host:
            yield from _ip_or_host(host, at + u.lower().find(host.lower()), 0.95, 0.95, order, s)
        if s.mask_ports and port not in ("", "0") and f":{port}" in u:
            yield plain("Port", at + u.index(f":{port}") + 1, len(port), 0.99, MEDIUM, order)
        if s.mask_databases and segment and f"/{segment[1]}" in u:
            yield plain("DatabaseName", at + u.index(f"/{segment[1]}") + 1, len(segment[1]), 0.95, MEDIUM, order)


def database_uris(t: Text, s: Settings, order: int) -> Iterable[Finding]:
    return _uris(t, P.DATABASE_URI, "DatabaseUrl", 0.99, "DatabaseCredential", order, s)


def credential_urls(t: Text, s: Settings, order: int) -> Iterable[Finding]:
    return _uris(t, P.URL, "SensitiveUrl", 0.95, "PasswordLike", order, s)


def connection_strings(t: Text, s: Settings, order: int) -> Iterator[Finding]:
    """The whole string, and its password, user, host, port and database by patterns inside it."""
    if ";" not in t.text or "=" not in t.text:
        return
    for m in compiled(P.CONNECTION_STRING).finditer(t.text):
        inner = Text(m[0])

        def nested(pattern: str, category: str, confidence: float, severity: int, inner=inner, m=m) -> Iterator[Finding]:
            for x in compiled(pattern).finditer(inner.text):
                yield plain(category, m.start() + x.end(1), len(x[2]), confidence, severity, order)

        yield plain("ConnectionString", m.start(), len(m[0]), 0.95, LOW, order)
        if s.mask_passwords:
            yield from nested(P.CONN_PASSWORD, "DatabaseCredential", 0.99, CRITICAL)
            yield from nested(P.CONN_USER, "Username", 0.90, MEDIUM)
        for x in compiled(P.CONN_HOST).finditer(inner.text):
            at, value = m.start() + x.end(1), x[2]
            name = re.search("^([^:,]+)[:,]", value)
            if name and s.mask_ports and len(value) > name.end():
                yield plain("Port", at + name.end(), len(value) - name.end(), 0.95, MEDIUM, order)
            yield from _ip_or_host(name[1] if name else value, at, 0.90, 0.90, order, s)
        if s.mask_ports:
            yield from nested(P.CONN_PORT, "Port", 0.95, MEDIUM)
        if s.mask_databases:
            yield from nested(P.CONN_DATABASE, "DatabaseName", 0.90, MEDIUM)


def cloud_credentials(t: Text, s: Settings, order: int) -> Iterable[Finding]:
    return _each(t, P.CLOUD, "CloudCredential", 0.99, CRITICAL, order) if s.mask_secrets and t.has("_secret", "_credentials") else ()


def auth_headers(t: Text, s: Settings, order: int) -> Iterable[Finding]:
    return _each(t, P.AUTH_HEADER, "AuthHeader", 0.99, CRITICAL, order) if s.mask_secrets and t.has("bearer", "authorization", "x-api-key") else ()


def api_keys(t: Text, s: Settings, order: int) -> Iterable[Finding]:
    return _each(t, P.API_KEY, "ApiKey", 0.99, CRITICAL, order) if s.mask_secrets and t.has("akia", "sk-", "ghp_", "ya29.", "aiza") else ()


def jwts(t: Text, s: Settings, order: int) -> Iterable[Finding]:
    return _each(t, P.JWT, "TokenLike", 0.95, HIGH, order) if s.mask_secrets and "ey" in t.text and "." in t.text else ()


def private_keys(t: Text, s: Settings, order: int) -> Iterable[Finding]:
    return _each(t, P.PRIVATE_KEY, "PrivateKey", 1.0, CRITICAL, order) if s.mask_secrets and "-----BEGIN" in t.text else ()


def _by_word(s: Settings, words: str, what: Callable[[re.Match[str]], str]) -> Callable[[re.Match[str]], bool] | None:
    """Keeps a match by the toggle for passwords if its text has one of the words, else by the one for secrets."""
    if s.mask_passwords and s.mask_secrets:
        return None
    return lambda m: bool(compiled(words).search(what(m))) == s.mask_passwords


def json_secrets(t: Text, s: Settings, order: int) -> Iterable[Finding]:
    if not (s.mask_passwords or s.mask_secrets) or ":" not in t.text or not t.has("password", "pwd", "secret", "token", "api"):
        return ()
    return _each(t, P.JSON_SECRET, "JsonSecret", 0.95, HIGH, order, _by_word(s, "(?i)password|pwd", lambda m: m[0]))


def environment_variables(t: Text, s: Settings, order: int) -> Iterable[Finding]:
    if not (s.mask_passwords or s.mask_secrets) or "=" not in t.text or not t.has("password", "secret", "token", "key", "_ur", "connection_string"):
        return ()
    return _each(t, P.ENV_VAR, "EnvironmentVariable", 0.95, CRITICAL, order, _by_word(s, "(?i)PASSWORD|PWD", lambda m: m[0].partition("=")[0]))


def hashes_in_context(t: Text, s: Settings, order: int) -> Iterable[Finding]:
    return _each(t, P.HASH_CONTEXT, "HashContext", 0.90, HIGH, order) if s.mask_hashes and t.long_hex and t.has("md5", "sha1", "sha256", "sha512", "checksum", "hash") else ()


def standalone_hashes(t: Text, s: Settings, order: int) -> Iterable[Finding]:
    return _each(t, P.HASH_ID, "HashId", 0.85, MEDIUM, order) if s.mask_hashes and t.long_hex else ()


def ipv4_addresses(t: Text, s: Settings, order: int) -> Iterator[Finding]:
    if not (s.mask_private_ip or s.mask_public_ip) or not t.digit or "." not in t.text:
        return
    for m in compiled(P.IPV4).finditer(t.text):
        if valid_ipv4(m[0]):
            private = private_ipv4(m[0])
            if s.mask_private_ip if private else s.mask_public_ip:
                yield plain("PrivateIp" if private else "PublicIp", m.start(), len(m[0]), 0.90, LOW, order)


def ipv6_addresses(t: Text, s: Settings, order: int) -> Iterable[Finding]:
    return _each(t, P.IPV6, "Ipv6", 0.90, LOW, order, lambda m: valid_ipv6(m[0])) if s.mask_public_ip and t.text.count(":") > 1 else ()


def emails(t: Text, s: Settings, order: int) -> Iterator[Finding]:
    """Not inside an address: no ``://`` before the match without a blank, tab or line end between."""
    if not s.mask_emails or "@" not in t.text:
        return
    runs = [(m.end(), m.end(1)) for m in re.finditer(r"://(?=([^ \t\r\n]*))", t.text)]
    starts = [a for a, _ in runs]
    for m in compiled(P.EMAIL).finditer(t.text):
        k = bisect_right(starts, m.start()) - 1
        if k < 0 or runs[k][1] < m.start():
            yield plain("Email", m.start(), len(m[0]), 0.90, MEDIUM, order)


def phones(t: Text, s: Settings, order: int) -> Iterable[Finding]:
    return _each(t, P.PHONE, "Phone", 0.90, MEDIUM, order) if s.mask_phones and t.digit and compiled(r"\d{3}[-.\s]?\d{4}").search(t.text) else ()


def hostnames(t: Text, s: Settings, order: int) -> Iterable[Finding]:
    if not s.mask_domains or not compiled(r"\.[a-zA-Z0-9]").search(t.text):
        return ()
    return _each(t, P.HOSTNAME, "Hostname", 0.80, LOW, order, lambda m: m.start() == 0 or t.text[m.start() - 1] != "@")


def key_values(t: Text, s: Settings, order: int) -> Iterator[Finding]:
    """The finding is the value itself; the key decides how sure and how severe."""
    if not (s.mask_passwords or s.mask_secrets) or not t.has("password", "pwd", "secret", "token", "key"):
        return
    keep = _by_word(s, "(?i)^(password|pwd)", lambda m: m[1])
    for m in compiled(P.KEY_VALUE).finditer(t.text):
        if keep is None or keep(m):
            explicit = m[1][:8].lower() == "password"
            yield "PasswordLike", m.end(1), len(m[2]), 0.99 if explicit else 0.90, CRITICAL if explicit else MEDIUM, m.end(1), len(m[2]), "Regex", order


@lru_cache(64)
def usable(custom: tuple[str, ...]) -> tuple[re.Pattern[str], ...]:
    """User patterns, without case. Blank and invalid ones, and those that match the empty text, are left out."""
    out = []
    for pattern in custom:
        try:
            rx = re.compile("(?i)" + pattern, re.A)
        except re.error:
            continue
        if pattern.strip() and not rx.search(""):
            out.append(rx)
    return tuple(out)


def custom(t: Text, s: Settings, order: int) -> Iterator[Finding]:
    for rx in usable(s.custom_patterns):
        for m in rx.finditer(t.text):
            if m[0]:
                yield plain("SecretLike", m.start(), len(m[0]), 0.99, HIGH, order, "CustomRule")


DETECTORS: tuple[Callable[[Text, Settings, int], Iterable[Finding]], ...] = (
    database_uris, credential_urls, connection_strings, cloud_credentials, auth_headers, api_keys, jwts, private_keys, json_secrets, environment_variables, hashes_in_context,
    standalone_hashes, ipv4_addresses, ipv6_addresses, emails, phones, hostnames, key_values, custom,
)


def detect(text: str | None, s: Settings, only: tuple[str, ...] | None = None) -> list[Finding]:
    """All findings of a text, in detector order; null text has none."""
    if s.bypass or not text:
        return []
    t = Text(text)
    return [f for k, detector in enumerate(DETECTORS) if only is None or detector.__name__ in only for f in detector(t, s, k)]


def filter_allowed(text: str, findings: list[Finding], s: Settings) -> list[Finding]:
    """Findings without allow-listed hosts (equal to or below an allowed domain) and addresses; other categories are not touched."""
    domains = [d.strip().lower() for d in s.allowed_domains if d.strip()]
    addresses = {a.strip().lower() for a in s.allowed_ips if a.strip()}
    if not domains and not addresses:
        return findings

    def allowed(f: Finding) -> bool:
        value = text[f[1] : f[1] + f[2]].lower()
        if f[0] in ("Hostname", "Domain"):
            return any(value == d or value.endswith("." + d) for d in domains)
        return f[0] in ("PublicIp", "PrivateIp") and value in addresses

    return [f for f in findings if not allowed(f)]


def ordered(findings: list[Finding]) -> list[Finding]:
    """By start, longest first, most severe first, surest first, then detector."""
    return sorted(findings, key=lambda f: (f[1], -f[2], -f[4], -f[3], f[8], f[0]))


def mask_spans(findings: list[Finding], size: int) -> list[Span]:
    """Valid spans to mask, not merged yet, of ordered findings of a text of ``size`` characters.

    A user name is masked only when something sensitive was met before it: any credential, or an earlier sensitive finding.
    """
    sure = [f for f in findings if f[3] >= LEAST_CONFIDENCE]
    credentials = [f for f in sure if f[0] in CREDENTIALS]
    spans = []
    for category, start, length, confidence, severity, value_start, value_length, *_ in credentials:
        full = severity == CRITICAL or confidence >= 0.99 or category not in PARTIAL_CREDENTIALS
        spans.append((start if value_start is None else value_start, length if value_length is None else value_length, FULL if full else PARTIAL))
    met = bool(credentials)
    for category, start, length, *_ in sure:
        if category in CREDENTIALS:
            continue
        if category in FULL_CONTEXT or category == "Username" and met:
            spans.append((start, length, FULL))
        elif category in SENSITIVE_CONTEXT:
            spans.append((start, length, PARTIAL))
        met = met or category in SENSITIVE_CONTEXT
    return [x for x in spans if x[0] >= 0 and x[1] > 0 and x[0] + x[1] <= size]


def _span_order(span: Span) -> tuple:
    """By start, longest first, then mode; nulls last."""
    start, length, mode = span
    return start is None, start or 0, length is None, -(length or 0), mode is None, mode or 0


def _larger(a: int | None, b: int | None) -> int | None:
    return b if a is None else a if b is None else max(a, b)


def merge_spans(spans: Iterable[Span]) -> list[Span]:
    """Spans that overlap or touch become one; it is full if any of them is. One with a null start joins nothing, one with a null length reaches nowhere."""
    out: list[list[int | None]] = []
    for start, length, mode in sorted(spans, key=_span_order):
        end = None if start is None or length is None else start + length
        if out and start is not None and out[-1][1] is not None and out[-1][1] >= start:
            out[-1][1:] = _larger(out[-1][1], end), _larger(out[-1][2], mode)
        else:
            out.append([start, end, mode])
    return [(a, None if b is None else b - a, mode) for a, b, mode in out]


def summarize(findings: list[Finding], plan: list[Span]) -> tuple:
    """(is_sensitive, confidence, severity, primary_category, findings, plan)."""
    credentials = [f for f in findings if f[0] in CREDENTIALS and f[3] >= LEAST_CONFIDENCE]
    context = [f for f in findings if f[0] not in CREDENTIALS]
    counted = [f for f in context if f[3] >= LEAST_CONFIDENCE and f[0] in SENSITIVE_CONTEXT]
    sensitive = bool(credentials or counted) and bool(plan)
    sure = max((f[3] for f in credentials), default=0.5 if context else 0.0)
    worst = max((f[4] for f in credentials + counted), default=0)
    return sensitive, sure, worst, findings[0][0] if sensitive and findings else "Normal", findings, plan


def classify(text: str | None, s: Settings, extra: Iterable[Finding] = ()) -> tuple:
    """The classification of a text. ``extra`` adds findings from elsewhere after ordering. A null text is empty."""
    text = text or ""
    found = ordered(filter_allowed(text, detect(text, s), s))
    found.extend(extra)
    return summarize(found, merge_spans(mask_spans(found, len(text))))


def stars(length: int) -> int:
    """Masked characters of a partial span: all of up to four, else three quarters rounded up."""
    return length if length <= 4 else (3 * length + 3) // 4


def masked_chars(span: Span) -> int:
    return span[1] if span[2] == FULL else stars(span[1])


def mask_plan(text: str | None, result: tuple) -> tuple:
    """(success, safe_text, error, masked_chars, sensitive_chars) of masking by plan: null text fails, a text that is not sensitive
    stays, a sensitive one without a plan fails, and so does a plan whose spans overlap or leave the text."""
    sensitive, plan = result[0], result[5]
    if text is None:
        return False, None, "no text", 0, 0
    if not sensitive:
        return True, text, None, 0, 0
    if not plan:
        return False, None, "empty plan", 0, 0
    at, out = 0, []
    for k, (start, length, _) in enumerate(plan):
        if start < 0 or length <= 0 or start + length > len(text) or k and start < at:
            return False, None, "invalid plan", 0, 0
        n = masked_chars(plan[k])
        out += [text[at:start], "*" * n, text[start + n : start + length]]
        at = start + length
    return True, "".join(out) + text[at:], None, sum(map(masked_chars, plan)), sum(x[1] for x in plan)


def mask_findings(text: str, findings: Iterable[tuple[int, int]]) -> str:
    """Preview by (start, length) of findings, last start first: each is masked by the partial rule and its tail comes from the
    raw text, so an outer finding that starts earlier uncovers the tail of what it encloses."""
    out = list(text)
    for start, size in sorted(findings, key=lambda f: -f[0]):
        if start >= 0 and size > 0 and start + size <= len(text):
            n = stars(size)
            out[start : start + size] = "*" * n + text[start + n : start + size]
    return "".join(out)


def protect(text: str | None, s: Settings, extra: Iterable[Finding] = ()) -> tuple[tuple, tuple]:
    """(classification, masked): masked by plan, and with double-layer masking what the first pass left is analysed and
    masked again. If the second pass fails the first one's text stays."""
    result = classify(text, s, extra)
    masked = mask_plan(text, result)
    if s.double_layer and not s.bypass and result[0] and masked[0]:
        again = mask_plan(masked[1], classify(masked[1], s))
        if again[0]:
            masked = (masked[0], again[1], *masked[2:])
    return result, masked
