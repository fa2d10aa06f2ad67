"""Synthetic labelled text: templates with placeholders, entity values, padding and contrastive pairs, at any scale.

Values are drawn from hashes of (seed, row, place), so every row can be made anew on any executor; there is no sequential
random state. A template is text with ``{KIND}`` placeholders; kinds without a label are hard negatives.
"""

from __future__ import annotations

import functools
import itertools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwright.functions.spans import let, running_sums
from maskwright.operators.dataset import hash_split
from maskwright.operators.policy import fenced
from maskwright.operators.tags import encode, span_errors, tokens

#: Label of each kind of placeholder; None for what only looks like an entity.
KINDS = {
    "IPV4": "NETWORK", "IPV6": "NETWORK", "MAC": "NETWORK", "PORT": "NETWORK", "HOST": "HOSTINFO", "NAME": "PII", "EMAIL": "PII", "PHONE": "PII", "ADDRESS": "PII", "USER": "PII", "SECRET": "SECRET",
    "VERSION": None, "TIME": None, "COUNT": None, "GUID": None, "FILE": None, "WORD": None,
}
_NAMES = ("Ada", "Ben", "Chloe", "Dmitri", "Elena", "Farid", "Grace", "Hiro", "Ines", "Jonas")
_USERS = ("svc", "deploy", "reader", "backup", "ops", "batch")
_PLACES = ("Oak Street", "Mill Lane", "Harbour Road", "Station Square", "Hill View")
_WORDS = ("cache", "worker", "queue", "gateway", "billing", "report", "session", "index")
_PLACEHOLDER = r"\{([A-Z0-9]+)\}"

#: (family, text); users bring their own table.
TEMPLATES = (
    ("auth", "login failed for {NAME} from {IPV4}"), ("auth", "token {SECRET} refused at {TIME}"), ("mail", "bounce from {EMAIL} via {HOST}:{PORT}"), ("net", "route {IPV6} dev {MAC} count {COUNT}"),
    ("crm", "call {NAME} at {PHONE}, {ADDRESS}"), ("build", "release {VERSION} of {WORD} wrote {FILE}"), ("trace", "request {GUID} to {HOST} took {COUNT} ms"),
)
#: (head, tail, share in a hundred): none, a log line, code, JSON.
PADDING = (("", "", 30), ("2024-05-01T10:00:00Z [Info] app: ", "", 20), ('log("', '");', 25), ('{"message": "', '"}', 25))
#: Compound forms (family, text), in which entities touch.
COMPOSITES = (
    ("socket", "listening at {HOST}:{PORT}"), ("socket", "tcp://{IPV4}:{PORT} is up"), ("db", "postgres://{USER}:{SECRET}@{HOST}:{PORT}/sales"), ("db", "Server={HOST};User Id={USER};Password={SECRET};"),
    ("bracketed", "bind [{IPV6}]:{PORT}"), ("bracketed", "probe of [{IPV6}] ended"), ("ssh", "ssh {USER}@{HOST} -p {PORT}"), ("ssh", "scp -P {PORT} {FILE} {USER}@{IPV4}:/tmp/"),
    ("host_port", "ws://{HOST}:{PORT}/feed"), ("host_port", "{HOST} answered with code {COUNT}"),
)
#: Contexts (family, text) that a form stands in, and what is mixed in as a hard negative.
CONTEXTS = (("auth", "audit: {FORM} (attempt {COUNT})"), ("auth", "{FORM}; retry at {TIME}"), ("mail", "queue {WORD}: {FORM}"), ("net", "kernel: {FORM}"), ("crm", "note by {NAME}: {FORM}"), ("build", "step {COUNT}: {FORM}"), ("trace", "[{GUID}] {FORM}"))
NEGATIVES = (" build {VERSION}", " id {GUID}", " at {TIME}", " see {FILE}")


def _number(key: Column, n: int) -> Column:
    return F.pmod(key, F.lit(n))


def _pick(key: Column, values: tuple[str, ...]) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (_number(key, len(values)) + 1).cast("int"))


def entity(kind: Column, key: Column) -> Column:
    """A value of the kind, decided by the key; an unknown kind gives an empty text."""
    part = lambda k: F.xxhash64(key, F.lit(k))
    hexed = lambda k, n: F.substring(F.md5(F.concat_ws(":", key, F.lit(k))), 1, n)
    name, word = _pick(part(1), _NAMES), _pick(part(2), _WORDS)
    made = {
        "IPV4": F.concat_ws(".", *(_number(part(k), 254) + 1 for k in range(4))),
        "IPV6": F.concat(F.lit("fe80::"), hexed(1, 4), F.lit(":"), hexed(2, 4)),
        "MAC": F.concat_ws(":", *(hexed(k, 2) for k in range(6))),
        "PORT": (_number(part(1), 64511) + 1024).cast("string"),
        "HOST": F.concat(word, F.lit("-"), _number(part(3), 90), F.lit(".prod.example.com")),
        "NAME": name,
        "USER": F.concat(_pick(part(1), _USERS), F.lit("_"), _number(part(3), 50)),
        "EMAIL": F.concat(F.lower(name), _number(part(3), 100), F.lit("@mail.example.com")),
        "PHONE": F.concat(F.lit("+1 ("), _number(part(1), 800) + 200, F.lit(") "), _number(part(2), 800) + 200, F.lit("-"), F.lpad(_number(part(3), 10_000).cast("string"), 4, "0")),
        "ADDRESS": F.concat(_number(part(1), 200) + 1, F.lit(" "), _pick(part(2), _PLACES)),
        "SECRET": F.substring(F.base64(F.unhex(F.sha2(key.cast("string"), 256))), 1, 32),
        "VERSION": F.concat_ws(".", *(_number(part(k), 20) for k in range(3))),
        "TIME": F.concat_ws(":", *(F.lpad(_number(part(k), n).cast("string"), 2, "0") for k, n in enumerate((24, 60, 60)))),
        "COUNT": _number(part(1), 100_000).cast("string"),
        "GUID": F.concat_ws("-", hexed(1, 8), hexed(2, 4), hexed(3, 4), hexed(4, 4), hexed(5, 12)),
        "FILE": F.concat(word, F.lit("_"), _number(part(3), 50), F.lit(".py")),
        "WORD": word,
    }
    return functools.reduce(lambda e, kv: F.when(kind == kv[0], kv[1]).otherwise(e), made.items(), F.lit(""))


def render(template: Column, key: Column) -> Column:
    """struct<text, spans>: placeholders replaced in order, and the places of labelled values."""

    def filled(names: Column) -> Column:
        values = F.transform(names, lambda n, i: entity(n, F.xxhash64(key, i)))
        gaps = F.split(template, _PLACEHOLDER, -1)
        return let(F.struct(names.alias("names"), values.alias("values"), gaps.alias("gaps")), joined)

    def joined(x: Column) -> Column:
        names, values, gaps = x["names"], x["values"], x["gaps"]
        text = F.concat(F.array_join(F.zip_with(F.slice(gaps, F.lit(1), F.size(values)), values, lambda g, v: F.concat(g, v)), ""), F.element_at(gaps, -1))
        before = running_sums(F.zip_with(F.slice(gaps, F.lit(1), F.size(values)), values, lambda g, v: F.length(g) + F.length(v)))
        labels = F.create_map(*(F.lit(v) for kv in KINDS.items() if kv[1] for v in kv))
        spans = F.transform(
            F.arrays_zip(names.alias("name"), values.alias("value"), F.slice(gaps, F.lit(1), F.size(values)).alias("gap"), before.alias("at")),
            lambda s: F.struct((s["at"] + F.length(s["gap"])).alias("start"), (s["at"] + F.length(s["gap"]) + F.length(s["value"])).alias("end"), F.try_element_at(labels, s["name"]).alias("label")),
        )
        return F.struct(text.alias("text"), F.filter(spans, lambda s: s["label"].isNotNull()).alias("spans"))

    return let(F.regexp_extract_all(template, F.lit(_PLACEHOLDER), F.lit(1)), filled)


def padded(rendered: Column, key: Column) -> Column:
    """The rendered text in one of the paddings, its spans shifted."""
    drawn, bounds = _number(F.xxhash64(key, F.lit("pad")), 100), tuple(itertools.accumulate(share for _, _, share in PADDING))
    choose = lambda k: functools.reduce(lambda e, x: F.when(drawn < x[1], x[0][k]).otherwise(e), reversed(tuple(zip(PADDING, bounds, strict=True))), F.lit(""))
    head, tail = choose(0), choose(1)
    shift = lambda s: F.struct((s["start"] + F.length(head)).alias("start"), (s["end"] + F.length(head)).alias("end"), s["label"].alias("label"))
    return F.struct(F.concat(head, rendered["text"], tail).alias("text"), F.transform(rendered["spans"], shift).alias("spans"))


def templates(spark: SparkSession, rows: tuple[tuple[str, str], ...] = TEMPLATES) -> DataFrame:
    return spark.createDataFrame([(f"{family}_{k}", family, text) for k, (family, text) in enumerate(rows)], "template_id string, family string, template string")


def generate(table: DataFrame, per_template: int, seed: int = 42) -> DataFrame:
    """``per_template`` padded instances of each template, with the split of its id: template_id, family, n, split, text, spans."""
    rows = table.withColumn("n", F.explode(F.sequence(F.lit(1), F.lit(per_template))))
    key = F.xxhash64(F.lit(seed), "template_id", "n")
    made = rows.withColumn("_key", key).withColumn("_r", padded(render(F.col("template"), F.col("_key")), F.col("_key")))
    return made.select("template_id", "family", "n", hash_split(F.col("template_id")).alias("split"), F.col("_r.text").alias("text"), F.col("_r.spans").alias("spans"))


def minimal_pairs(spark: SparkSession, n: int | DataFrame, seed: int = 42) -> DataFrame:
    """Contrastive pairs: one sentence with an entity and with what only looks like one: pair, kind, text, spans.

    ``n`` is how many numbers are used, or a table whose column n holds them."""
    pairs = (("IPV4", "VERSION", "found {X} in line"), ("IPV6", "TIME", "at {X} it stopped"), ("SECRET", "GUID", "value {X} given"), ("HOST", "FILE", "open {X} now"), ("PORT", "COUNT", "listening {X}"), ("NAME", "WORD", "assigned to {X}"))
    choice = F.explode(F.array(*(F.struct(F.lit(k).alias("pair"), F.lit(kind).alias("kind"), F.lit(t.replace("X", kind)).alias("template")) for k, (a, b, t) in enumerate(pairs) for kind in (a, b))))
    numbers = n.select("n") if isinstance(n, DataFrame) else spark.range(n).select(F.col("id").alias("n"))
    rows = numbers.select("n", choice.alias("c")).select("n", "c.*")
    made = rows.withColumn("_r", render(F.col("template"), F.xxhash64(F.lit(seed), "n", "pair")))
    return made.select("pair", "n", "kind", F.col("_r.text").alias("text"), F.col("_r.spans").alias("spans"))


def expand_contexts(forms: DataFrame, contexts: DataFrame) -> DataFrame:
    """Each form (template_id, family, template) in each context (context, text) of its family: a table for ``generate``."""
    both = forms.join(contexts.select("family", "context", F.col("text").alias("_text")), "family")
    return both.select(F.concat_ws("/", "template_id", "context").alias("template_id"), "family", F.replace("_text", F.lit("{FORM}"), "template").alias("template"))


def contexts(spark: SparkSession, rows: tuple[tuple[str, str], ...] = CONTEXTS) -> DataFrame:
    return spark.createDataFrame([(family, f"ctx{k}", text) for k, (family, text) in enumerate(rows)], "family string, context string, text string")


def composites(numbers: DataFrame, forms: DataFrame, seed: int = 42) -> DataFrame:
    """For each number ``n`` and family of compound forms (family, template) one rendered form, chosen by a hash: family, n, text, spans."""
    listed = forms.groupBy("family").agg(F.sort_array(F.collect_list("template")).alias("_forms"))  # a small table of forms
    rows = numbers.select("n").crossJoin(F.broadcast(listed)).withColumn("_key", F.xxhash64(F.lit(seed), "family", "n"))
    chosen = F.element_at("_forms", (F.pmod(F.xxhash64("_key", F.lit("form")), F.size("_forms")) + 1).cast("int"))
    made = rows.select("family", "n", padded(render(chosen, F.col("_key")), F.col("_key")).alias("_r"))
    return made.select("family", "n", F.col("_r.text").alias("text"), F.col("_r.spans").alias("spans"))


def generation_plan(table: DataFrame, plan: DataFrame, negative_percent: int = 12, seed: int = 42) -> DataFrame:
    """Instances by a plan (family, total): each of a family's templates gets total // templates, and in about ``negative_percent`` of
    a hundred rows a hard negative is mixed in. Columns as of ``generate``."""
    share = table.groupBy("family").agg(F.count(F.lit(1)).alias("_of")).join(plan, "family").select("family", F.expr("cast(total div _of as int)").alias("_each"))
    rows = table.join(F.broadcast(share), "family").filter("_each > 0").withColumn("n", F.explode(F.sequence(F.lit(1), F.col("_each"))))
    rows = rows.withColumn("_key", F.xxhash64(F.lit(seed), "template_id", "n"))
    mixed = F.when(_number(F.xxhash64("_key", F.lit("negative")), 100) < negative_percent, F.concat("template", _pick(F.xxhash64("_key", F.lit("which")), NEGATIVES))).otherwise(F.col("template"))
    made = rows.withColumn("_r", padded(render(mixed, F.col("_key")), F.col("_key")))
    return made.select("template_id", "family", "n", hash_split(F.col("template_id")).alias("split"), F.col("_r.text").alias("text"), F.col("_r.spans").alias("spans"))


def challenge(rendered: DataFrame) -> DataFrame:
    """(text, tokens, tags) of rendered texts; those whose spans leave the text, overlap or don't keep their tokens are left out."""
    tagged = fenced(fenced(rendered, F.struct("text", "spans"), "_r").select("_r.*").filter(~span_errors(F.col("spans"), F.length("text"))), tokens(F.col("text")), "_t")
    tagged = tagged.select("text", F.transform("_t", lambda t: t["token"]).alias("tokens"), encode(F.col("_t"), F.col("spans")).alias("tags"), "spans")
    return tagged.filter(F.size(F.filter("tags", lambda t: t.startswith("B-"))) <= F.size("spans")).filter((F.size("spans") == 0) | F.exists("tags", lambda t: t != "O")).drop("spans")


def composite_forms(spark: SparkSession, rows: tuple[tuple[str, str], ...] = COMPOSITES) -> DataFrame:
    return spark.createDataFrame(list(rows), "family string, template string")
