"""Operator 5, secret scan in native expressions: base patterns, and character Markov models compared by log-likelihood ratio.

Two first-order Markov models over characters, of random strings and of ordinary ones, are trained on the driver from
labelled samples (``labelled_samples``: keys in several alphabets against identifiers, UUIDs, dates, paths and versions).
Their log-likelihood ratio is a table of integer weights for character pairs, a constant of the
plan. A run of 20 or more token characters with a letter and a digit is a secret when its summed weights reach a bound.
Spans come from the pieces between matches, so documents pass once through built-in expressions, with no Python and no
shuffle.

Edge cases: null text reads as empty and has no spans; repeated rows are scanned each; a null id passes through; an empty
table gives no rows; other columns are not read. Offsets are code points, ends are exclusive. A Markov span within a base
span is not added; one that runs beyond it is, so spans can overlap.
"""

from __future__ import annotations

import hashlib
import math
from base64 import b64encode
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwright.functions.spans import let, running_sums
from maskwright.llm.support import slices, table

ASSIGN = r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
#: Greedy runs of at least so many characters are the same as all maximal runs of which the short ones are dropped.
HEX = r"[0-9a-f]{32,}"
RUN = r"[A-Za-z0-9+/_-]{20,}"
LEAST = {"assign": 8, "access": 16, "hex": 32, "markov": 20}
KINDS = ("assign", "access", "hex", "markov")

ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_-"
_K = len(ALPHABET)
#: Least sum of weights (a thousandth of a natural logarithm each) of a secret.
BOUND = 8_000
SAMPLES = 4_000

_IDENTIFIER_WORDS = (
    "get set add new user name value item list index count total data file path line text word table column row key map type class object "
    "request response server client config option default error message handler event state session account order price date time start end "
    "first last next open close read write load save update delete create build parse format print report version test check result number "
    "string buffer stream cache token field model view controller service manager factory thread process memory network socket address port "
    "the and that with from this have which their would there about other into more some could them than been their only over also after"
).split()


_PATH_WORDS = "usr lib local share home var opt bin etc src x86_64 linux gnu aarch64 amd64 python3 node_modules v2 2024 site packages main release snapshot".split()


class _Draw:
    """Numbers from hashes of (seed, k): the same on every run and machine."""

    def __init__(self, seed: str, k: int):
        self.seed, self.k, self.n = seed, k, 0

    def bytes(self, n: int) -> bytes:
        self.n += 1
        return hashlib.shake_256(f"{self.seed} {self.k} {self.n}".encode()).digest(n)

    def below(self, n: int) -> int:
        return int.from_bytes(self.bytes(8), "big") % n

    def words(self, n: int, of: list[str] = _IDENTIFIER_WORDS) -> list[str]:
        return [of[self.below(len(of))] for _ in range(n)]

    def of(self, alphabet: str, n: int) -> str:
        return "".join(alphabet[b % len(alphabet)] for b in self.bytes(n))


def _random_text(d: _Draw) -> str:
    lower, digits = "abcdefghijklmnopqrstuvwxyz", "0123456789"
    return (
        lambda: b64encode(d.bytes(33)).decode(), lambda: d.bytes(20).hex(), lambda: d.bytes(24).hex().upper(), lambda: b64encode(d.bytes(33), b"-_").decode().replace("=", ""),
        lambda: d.of(lower + lower.upper() + digits, 32 + d.below(16)), lambda: d.of(lower + digits, 32 + d.below(8)), lambda: d.of(lower.upper() + "234567", 32),
    )[d.k % 7]()


def _ordinary_text(d: _Draw) -> str:
    words = d.words(3 + d.below(4))
    date = (f"{1990 + d.below(45)}", f"{1 + d.below(12):02}", f"{1 + d.below(28):02}")
    clock = (f"{d.below(24):02}", f"{d.below(60):02}", f"{d.below(60):02}")
    tail = str(d.below(100)) if d.below(3) == 0 else ""
    kind = d.k % 16
    if kind < 6:
        return (words[0] + "".join(w.title() for w in words[1:]), "_".join(words), "-".join(words), "/".join(words), "_".join(words).upper(), "".join(w.title() for w in words))[kind] + tail
    if kind == 6:
        raw = d.bytes(16).hex()
        return "-".join((raw[:8], raw[8:12], raw[12:16], raw[16:20], raw[20:]))
    if kind in (7, 9):
        return "-".join(date) + "T" + "-".join(clock) + "Z-" + "-".join(words)
    if kind == 10:
        return "/".join((*words[:2], *date, "-".join(d.words(4)) + "-" + str(d.below(100_000))))
    if kind == 11:
        return "/" + "/".join(d.words(2 + d.below(3), _PATH_WORDS) + d.words(2)) + "/" + str(d.below(10))
    if kind in (8, 12):
        return "-".join((words[0], str(d.below(10)), str(d.below(30)), str(d.below(100)), *d.words(2, _PATH_WORDS)))
    if kind == 13:
        return "_".join((words[0], words[1], "".join(date), f"{d.below(10**9):09}"))
    if kind == 14:
        return "/".join(d.words(2, _PATH_WORDS) + ["_".join(words), "-".join(d.words(2)) + str(d.below(1000))])
    return "+".join(words) + "+" + "".join(date) + "T" + "".join(clock)


def labelled_samples(n: int = SAMPLES, seed: str = "train") -> list[tuple[str, int]]:
    """(text, 1 for random or 0 for ordinary), ``n`` of each, the same on every run; another seed gives others."""
    return [(make(_Draw(f"{seed} {label}", k)), label) for k in range(n) for make, label in ((_random_text, 1), (_ordinary_text, 0))]


def train(samples: Iterable[tuple[str, int]]) -> list[int]:
    """Weights of all character pairs: 1000 times the logarithm of P(second | first) under random over that under identifiers."""
    counts = [[[0.5] * _K for _ in range(_K)] for _ in range(2)]
    index = {c: i for i, c in enumerate(ALPHABET)}
    for text, label in samples:
        for a, b in zip(text, text[1:], strict=False):
            if a in index and b in index:
                counts[label][index[a]][index[b]] += 1
    weights = []
    for a in range(_K):
        totals = [sum(counts[label][a]) for label in (0, 1)]
        weights += [round(1000 * (math.log(counts[1][a][b] / totals[1]) - math.log(counts[0][a][b] / totals[0]))) for b in range(_K)]
    return weights


def _matches(text: Column, pattern: str, keep: Callable[[Column], Column], group: int = 0) -> Column:
    """array<struct<start, end>> of the matches whose text (or given group) passes ``keep``."""
    found, values = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    gaps = F.transform(F.split(text, pattern, -1), F.length)

    def placed(x: Column) -> Column:
        rows = F.arrays_zip(x["m"].alias("m"), x["v"].alias("v"), x["gaps"].alias("gap"), running_sums(F.zip_with(x["m"], x["gaps"], lambda m, gap: F.length(m) + gap)).alias("at"))
        kept = F.filter(rows, lambda r: keep(r["v"]))
        return F.transform(kept, lambda r: F.struct((r["at"] + r["gap"]).alias("start"), (r["at"] + r["gap"] + F.length(r["m"])).alias("end")))

    return let(F.struct(found.alias("m"), values.alias("v"), F.slice(gaps, F.lit(1), F.size(found)).alias("gaps")), placed)


def _random(value: Column, weights: list[int], bound: int) -> Column:
    """Whether the summed pair weights reach the bound."""
    held = F.split(F.lit(",".join(map(str, weights))), ",").cast("array<int>")
    codes = F.transform(F.split(value, ""), lambda c: F.instr(F.lit(ALPHABET), c))  # 1-based; all characters of a run are in it
    pairs = F.zip_with(F.slice(codes, F.lit(1), F.size(codes) - 1), F.slice(codes, F.lit(2), F.size(codes) - 1), lambda a, b: F.element_at(held, (a - 1) * _K + b))
    return F.aggregate(pairs, F.lit(0), lambda total, w: total + w) >= bound


def find_spans(text: Column, weights: list[int], bound: int = BOUND) -> dict[str, Column]:
    """For each kind the spans of a text that is not null, as array<struct<start, end>>. A cheap test spares most texts the search."""
    none = F.array().cast("array<struct<start:int,end:int>>")
    long_enough = {k: (lambda n: lambda v: F.length(v) >= n)(n) for k, n in LEAST.items()}

    def gated(test: str, spans: Column) -> Column:
        return F.when(text.rlike(test), spans).otherwise(none)

    def is_secret(v: Column) -> Column:
        may = (F.length(v) >= LEAST["markov"]) & v.rlike("[0-9]") & v.rlike("[A-Za-z]")
        return F.when(may, _random(v, weights, bound)).otherwise(False)

    return {
        "assign": gated(r"(?i:d|secret|token|key)[\"']?\x20*[:=]", _matches(text, ASSIGN, long_enough["assign"], 2)),
        "access": gated("AKIA[A-Z0-9]{12}", _matches(text, ACCESS, long_enough["access"])),
        "hex": gated("[0-9a-f]{32}", _matches(text, HEX, long_enough["hex"])),
        "markov": gated("(?=[A-Za-z+/_-]{0,400}+[0-9])[A-Za-z0-9+/_-]{20}", _matches(text, RUN, is_secret)),
    }


def scan(docs: DataFrame, weights: list[int] | None = None, bound: int = BOUND, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, text and ``found``, array<struct<start, rank, end, kind>> in order of start and kind."""
    weights = train(labelled_samples()) if weights is None else weights
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    raw = rows.select("doc_id", "text", *(s.alias(f"s_{k}") for k, s in find_spans(F.col("text"), weights, bound).items()))

    def tagged(kind: str) -> Column:
        return F.transform(F.col(f"s_{kind}"), lambda s: F.struct(s["start"].alias("start"), F.lit(KINDS.index(kind)).alias("rank"), s["end"].alias("end"), F.lit(kind).alias("kind")))

    base = F.concat(*(tagged(k) for k in KINDS[:3]))
    added = F.filter(tagged("markov"), lambda m: ~F.exists(base, lambda b: (b["start"] <= m["start"]) & (m["end"] <= b["end"])))
    return raw.select("doc_id", "text", *(F.size(f"s_{k}").cast("long").alias(f"n_{k}") for k in KINDS[:3]), F.array_sort(F.concat(base, added)).alias("found"))


def digest(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def masked(text: Column, found: Iterable[Column], mask: str = "*") -> Column:
    """The text with every character of a span replaced, one kind of spans (rising and apart) after the other; its length stays."""

    def one(x: Column) -> Column:
        starts = F.concat(F.array(F.lit(0)), F.transform(x["s"], lambda s: s["end"]))
        ends = F.concat(F.transform(x["s"], lambda s: s["start"]), F.array(F.length(x["t"])))
        between = slices(x["t"], F.zip_with(starts, ends, lambda a, b: F.struct(a.alias("start"), b.alias("end"))))
        stars = F.concat(F.transform(x["s"], lambda s: F.repeat(F.lit(mask), s["end"] - s["start"])), F.array(F.lit("")))
        return F.when(F.size(x["s"]) > 0, F.array_join(F.zip_with(between, stars, lambda a, b: F.concat(a, b)), "")).otherwise(x["t"])

    for spans in found:
        text = let(F.struct(text.alias("t"), spans.alias("s")), one)
    return text


def mask_secrets(docs: DataFrame, weights: list[int] | None = None, bound: int = BOUND, text_col: str = "text") -> DataFrame:
    """``docs`` with its columns, secrets in the text masked. A null text stays null."""
    weights = train(labelled_samples()) if weights is None else weights
    text = F.coalesce(F.col(text_col), F.lit(""))
    kinds = find_spans(text, weights, bound)
    named = docs.withColumn("_spans", F.struct(*(s.alias(k) for k, s in kinds.items())))
    safe = masked(text, [F.col("_spans")[k] for k in kinds])
    return named.withColumn(text_col, F.when(F.col(text_col).isNotNull(), safe)).drop("_spans")


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scan(table(spark, sf_dir, "documents"))
    base = F.filter("found", lambda s: s["kind"] != "markov")
    return rows.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(digest(base), 256).alias("base_sha256"), digest(F.col("found")).alias("spans"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op5_secret_scan": op5_secret_scan}


def _oracle() -> str:
    """The same in DuckDB: the trained weights are integers, so both engines agree exactly."""
    weights = "[" + ",".join(map(str, train(labelled_samples()))) + "]"

    def spans(kind: str, pattern: str, ok: str, group: int = 0) -> str:
        p = pattern.replace("'", "''")
        return f"""s_{kind} AS (
  SELECT r, i, coalesce(list_sum(list_transform(g[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS start, length(m[i]) AS size, v[i] AS v
  FROM (SELECT r, regexp_extract_all(text, '{p}') AS m, regexp_extract_all(text, '{p}', {group}) AS v, regexp_split_to_array(text, '{p}') AS g, unnest(range(1, len(regexp_extract_all(text, '{p}')) + 1)) AS i FROM d)
  WHERE {ok}
)"""

    score = f"""list_sum(list_transform(range(1, length(v)), lambda k: {{w}}[(instr('{ALPHABET}', v[k]) - 1) * {_K} + instr('{ALPHABET}', v[k + 1])]))""".format(w="w")
    tagged = " UNION ALL ".join(f"SELECT r, start, {k} AS rank, start + size AS stop, '{kind}' AS kind FROM s_{kind}" for k, kind in enumerate(KINDS[:3]))
    return f"""
WITH weights AS (SELECT {weights} AS w),
d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
{spans('assign', ASSIGN, 'length(v[i]) >= 8', 2)},
{spans('access', ACCESS, 'length(m[i]) >= 16')},
{spans('hex', HEX, 'length(m[i]) >= 32')},
s_run AS (SELECT r, start, size, v FROM ({spans('x', RUN, "length(m[i]) >= 20 AND regexp_matches(m[i], '[0-9]') AND regexp_matches(m[i], '[A-Za-z]')")[len('s_x AS ('):-1]})),
base AS ({tagged}),
s_markov AS (
  SELECT s_run.* FROM s_run CROSS JOIN weights WHERE {score} >= {BOUND}
  AND NOT EXISTS (SELECT 1 FROM base b WHERE b.r = s_run.r AND b.start <= s_run.start AND s_run.start + s_run.size <= b.stop)
),
every AS (SELECT * FROM base UNION ALL SELECT r, start, 3, start + size, 'markov' FROM s_markov)
SELECT d.doc_id,
  count(*) FILTER (WHERE kind = 'assign') AS n_assign,
  count(*) FILTER (WHERE kind = 'access') AS n_access,
  count(*) FILTER (WHERE kind = 'hex') AS n_hex,
  sha256(coalesce(string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank) FILTER (WHERE kind <> 'markov'), '')) AS base_sha256,
  coalesce(string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank) FILTER (WHERE kind IS NOT NULL), '') AS spans
FROM d LEFT JOIN every e ON e.r = d.r GROUP BY d.r, d.doc_id
"""


ORACLES = {"op5_secret_scan": _oracle()}
