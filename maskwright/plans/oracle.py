"""Builders of DuckDB SQL for the oracles: match positions, and the payloads that both engines derive alike."""

from __future__ import annotations

# Payloads derived from key columns by expressions that Spark and DuckDB render alike: (table, id, text).
PAYLOADS = {
    "documents": ("documents", "doc_id", "text"),
    "conversations": ("conversations", "conv_id * 1000 + turn", "text"),
    "hosts": ("customer", "c_custkey", "concat('see node', c_custkey, '.example.com or mail u', c_custkey, '@h.example.org and a.b-c.net')"),
    "urls": ("pages", "page_id", "concat('see ', url, ' now')"),
    "db_uri": ("customer", "c_custkey", "concat('postgres://u', c_custkey, ':pw', c_custkey, '@10.', c_nationkey, '.0.', c_custkey % 250, ':5432/db', c_nationkey)"),
    "conn": ("supplier", "s_suppkey", "concat('Server=10.1.', s_nationkey, '.7,1433;Database=d', s_suppkey, ';User ID=u', s_suppkey, ';Password=p', s_suppkey, ';')"),
    "cloud": ("orders", "o_orderkey", "concat('AWS_SECRET_ACCESS_KEY=k', o_orderkey, 'Z')"),
    "auth": ("orders", "o_orderkey", "concat('Authorization: Bearer t', o_orderkey)"),
    "api": ("part", "p_partkey", "concat('id AKIA', lpad(cast(p_partkey as string), 16, '0'), ' and ghp_', lpad(cast(p_partkey as string), 36, 'a'))"),
    "jwt": ("part", "p_partkey", "concat('x eyA', p_partkey, '.b', p_size, '.c-', p_partkey, ' y')"),
    "pem": ("supplier", "s_suppkey", "concat('a -----BEGIN RSA PRIVATE KEY-----', chr(10), md5(s_name), chr(10), '-----END RSA PRIVATE KEY----- b')"),
    "json": ("customer", "c_custkey", "concat('{\"password\": \"p', c_custkey, '\", \"api_key\": \"k', c_custkey, '\"}')"),
    "env": ("orders", "o_orderkey", "concat('x', chr(10), 'export DB_PASSWORD=\"w', o_orderkey, '\"', chr(10), 'API_KEY=v', o_orderkey)"),
    "hash": ("part", "p_partkey", "concat('md5: ', md5(p_name), ' and ', md5(p_brand))"),
    "kv": ("customer", "c_custkey", "concat('my password=a', c_custkey, ' token: bcd', c_custkey, ' key=', c_nationkey)"),
    "ipv6": ("customer", "c_custkey", "concat('fe80::', c_nationkey, ' at 12:30:45 and 1:2:3:4:5:6:7:', c_nationkey, ' and ::1')"),
    "phone": ("customer", "c_custkey", "concat('call 1 (743) 555-', lpad(cast(c_custkey % 10000 as string), 4, '0'), ' or -1 743 555 3824')"),
}


def source(name: str) -> str:
    table, key, text = PAYLOADS[name]
    return f"SELECT {key} AS id, {text} AS text FROM {table}"


def quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def matches(src: str, pattern: str, grouped: bool = False) -> str:
    """SELECT id, i, start, m, pre, val, text for every match of the pattern in ``src(id, text)``."""
    p = quoted(pattern)
    pre, val = (f"regexp_extract_all(text, {p}, 1)", f"regexp_extract_all(text, {p}, 2)") if grouped else (f"list_transform(regexp_extract_all(text, {p}), lambda x: '')", f"regexp_extract_all(text, {p})")
    return f"""SELECT id, i, text, m[i] AS m, pre[i] AS pre, val[i] AS val,
      CAST(list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS start
    FROM (SELECT id, text, regexp_extract_all(text, {p}) AS m, {pre} AS pre, {val} AS val, regexp_split_to_array(text, {p}) AS g,
      unnest(range(1, len(regexp_extract_all(text, {p})) + 1)) AS i FROM ({src}) WHERE regexp_matches(text, {p}))"""


def findings(src: str, pattern: str, category: str, confidence: int, severity: int, grouped: bool = False, where: str = "true") -> str:
    """Finding rows (id, category, start, length, conf, severity, value_start, value_length) of a plain detector."""
    value = "start + length(pre) AS value_start, length(val) AS value_length" if grouped else "CAST(NULL AS BIGINT) AS value_start, CAST(NULL AS BIGINT) AS value_length"
    return f"SELECT id, {category} AS category, start, length(m) AS length, {confidence} AS conf, {severity} AS severity, {value} FROM ({matches(src, pattern, grouped)}) WHERE {where}"


VALID_IPV4 = r"^((25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])\.){3}(25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])$"
PRIVATE_IPV4 = r"^(10\.|192\.168\.|172\.(1[6-9]|2[0-9]|3[01])\.)"


def merged(spans: str) -> str:
    """SELECT id, start, length, mode of spans(id, start, length, mode) with overlapping and touching ones joined, by gaps and islands."""
    return f"""SELECT id, min(start) AS start, max(start + length) - min(start) AS length, max(mode) AS mode FROM (
      SELECT *, sum(fresh) OVER (PARTITION BY id ORDER BY start, length DESC, mode ROWS UNBOUNDED PRECEDING) AS island FROM (
        SELECT *, CASE WHEN start <= max(start + length) OVER (PARTITION BY id ORDER BY start, length DESC, mode ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM ({spans}))
    ) GROUP BY id, island"""


def masked(src: str, plan: str) -> str:
    """SELECT id, safe_text: texts with a plan(id, start, length, mode) applied; mode 2 is full."""
    stars = "CASE WHEN mode = 2 OR length <= 4 THEN length ELSE (3 * length + 3) // 4 END"
    return f"""SELECT s.id, coalesce(any_value(p.head), '') || coalesce(any_value(p.body), '') || CASE WHEN count(p.id) = 0 THEN any_value(s.text) ELSE substr(any_value(s.text), any_value(p.stop) + 1) END AS safe_text
    FROM ({src}) s LEFT JOIN (
      SELECT id, '' AS head, string_agg(substr(text, before + 1, start - before) || repeat('*', n) || substr(text, start + n + 1, length - n), '' ORDER BY start) AS body, max(start + length) AS stop FROM (
        SELECT p.id, start, length, CAST({stars} AS BIGINT) AS n, t.text, coalesce(lag(start + length) OVER (PARTITION BY p.id ORDER BY start), 0) AS before FROM ({plan}) p JOIN ({src}) t ON t.id = p.id
      ) GROUP BY id) p ON p.id = s.id GROUP BY s.id"""
