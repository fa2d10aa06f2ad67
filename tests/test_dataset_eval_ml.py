import hashlib
import json
import re

from pyspark.sql import functions as F

from maskwright.operators import dataset as S
from maskwright.operators import evaluation as E
from maskwright.operators import ml
from maskwright.operators import tags as T
from maskwright.settings import Settings


def one(spark, **columns):
    return spark.range(1).select(*(F.expr(v).alias(k) for k, v in columns.items()))


def test_hash_split_is_the_md5_number(spark):
    keys = [f"port_ctx_{k}" for k in range(200)]
    got = {r.k: r.s for r in spark.createDataFrame([(k,) for k in keys], "k string").select("k", S.hash_split(F.col("k")).alias("s")).collect()}
    for k in keys:
        n = int(hashlib.md5(k.encode()).hexdigest(), 16) % 100
        assert got[k] == ("test" if n < 15 else "val" if n < 30 else "train")


def test_redaction_equals_a_loop(spark):
    lines = ["see http://a.b/c and 10.0.0.1", "token=abc u@x.example.com", "password: x;y " + "a" * 40, "plain", "redis://h 'http://q'", ""]
    got = spark.createDataFrame(list(enumerate(lines)), "id int, line string").select("id", S.redact(F.col("line"))[0].alias("r"), S.redact(F.col("line"))[1].alias("f")).orderBy("id").collect()
    for row, line in zip(got, lines, strict=True):
        out, found = line, []
        for pattern, placeholder in S.REDACTIONS:
            for m in re.finditer(pattern, line, re.A):
                found.append((m.start(), m.end(), placeholder))
                out = re.sub(pattern, placeholder, out, flags=re.A)
        assert row.r == out and [(f.start, f.end, f.placeholder) for f in row.f] == found


def test_log_lines(spark):
    lines = ["2023-10-25T12:00:00.000Z [Information] Category: the message: x", "   at stack.frame"]
    got = spark.createDataFrame([(x,) for x in lines], "l string").select(S.parse_log(F.col("l")).alias("p")).collect()
    assert got[0].p.asDict() == {"ts": "2023-10-25T12:00:00.000Z", "level": "Information", "category": "Category", "message": "the message: x"}
    assert got[1].p.message == lines[1] and got[1].p.level is None


def test_bio(spark):
    df = one(spark, text="'ssh root@10.0.0.1 now'", spans="array(named_struct('start', 4, 'end', 8, 'label', 'PII'), named_struct('start', 9, 'end', 17, 'label', 'NETWORK'))")
    row = df.select(T.tokens(F.col("text")).alias("t"), T.encode(T.tokens(F.col("text")), F.col("spans")).alias("b"), T.span_errors(F.col("spans"), F.length("text")).alias("e")).first()
    assert [t.token for t in row.t] == re.findall(r"\w+|[^\w\s]", "ssh root@10.0.0.1 now")
    assert row.b == ["O", "B-PII", "O", "B-NETWORK", *["I-NETWORK"] * 6, "O"] and not row.e
    spaced = df.select(T.encode_spaced(T.space_tokens(F.col("text")), F.expr("array(named_struct('start', 4, 'end', 17, 'label', 'PII'))")).alias("b")).first().b
    assert spaced == ["O", "B-PII", "O"]
    bad = one(spark, s="array(named_struct('start', 0, 'end', 5, 'label', 'x'), named_struct('start', 4, 'end', 6, 'label', 'x'))")
    assert bad.select(T.span_errors(F.col("s"), F.lit(10)).alias("e")).first().e


def test_decode_and_validate(spark):
    df = one(spark, tags="array('B-PII','I-PII','I-SECRET','B-PII','B-PII','O','I-PII')", tokens="array('a','b','c','d','e','f','g')")
    row = df.select(T.decode(F.col("tags")).alias("s"), T.record_errors(F.col("tokens"), F.col("tags")).alias("e")).first()
    assert [(s.start, s.end, s.type) for s in row.s] == [(0, 2, "PII"), (3, 4, "PII"), (4, 5, "PII")]
    assert row.e == ["transition"]
    assert one(spark, t="array('B-X')", k="array()").select(T.record_errors(F.col("k"), F.col("t")).alias("e")).first().e == ["empty", "length", "label"]


def test_logits(spark):
    def row(k, size=8.0):
        return "array(" + ",".join(f"{size if j == k else 0.0}D" for j in range(9)) + ")"

    tags = [0, 1, 2, 4, 0, 8]  # O B-SECRET I-SECRET I-PII O I-NETWORK
    df = one(spark, logits="array(" + ",".join(map(row, tags)) + ")", offsets="transform(sequence(0, 5), i -> named_struct('start', i * 4, 'length', 3))")
    got = df.select(T.decode_logits(F.col("logits"), F.col("offsets"), 0.9).alias("e")).first().e
    assert [(e.category, e.start, e.length) for e in got] == [("PasswordLike", 4, 7), ("Email", 12, 3), ("PublicIp", 20, 3)]
    assert df.select(T.decode_logits(F.col("logits"), F.col("offsets"), 0.9999).alias("e")).first().e == []


def test_evaluation(spark):
    span = "rec int, start int, `end` int, type string"
    true = spark.createDataFrame([(1, 0, 4, "PII"), (1, 10, 14, "SECRET"), (2, 0, 4, "PII"), (3, 5, 9, "HOSTINFO")], span)
    pred = spark.createDataFrame([(1, 0, 4, "PII"), (1, 11, 13, "SECRET"), (2, 0, 4, "SECRET"), (4, 0, 2, "PII"), (1, 12, 20, "SECRET")], span)
    judged = E.classify_predictions(pred, true)
    kinds = {(r.rec, r.start): r.kind for r in judged.collect()}
    assert kinds == {(1, 0): "Exact", (1, 11): "Truncated", (2, 0): "WrongType", (4, 0): "Spurious", (1, 12): "Boundary"}
    lost = E.missed(judged, true)
    assert [(r.rec, r.start) for r in lost.collect()] == [(3, 5)]
    total = E.scores(judged, lost).filter("type = 'ALL'").first()
    assert (total.tp, total.fp, total.fn) == (1, 4, 1)
    assert E.gates(E.scores(judged, lost)).filter("precision_ok and recall_ok").count() == 0


def test_dedup_prefers_train(spark):
    rows = spark.createDataFrame([(1, ["a"], "test"), (2, ["a"], "train"), (3, ["a"], "train"), (4, ["b"], "val")], "ord int, tokens array<string>, split string")
    assert {r.ord for r in S.dedup_across(rows).collect()} == {2, 4}


def test_wordpiece(spark):
    vocab = ml.load_vocabulary(["[UNK]", "[CLS]", "[SEP]", "play", "##ing", "##ed", ".", "play"])
    assert ml.pieces("Playing played. xq", vocab, 20) == ([1, 3, 4, 3, 5, 6, 0, 2], [(0, 0), (0, 4), (4, 3), (8, 4), (12, 2), (14, 1), (16, 2), (0, 0)])
    assert len(ml.pieces("play " * 50, vocab, 10)[0]) == 10
    got = ml.tokenize(spark.createDataFrame([("playing",), (None,)], "text string"), vocab).collect()
    assert [list(r.pieces.ids) for r in got] == [[1, 3, 4, 2], [1, 2]]


def test_second_layer(spark):
    model = F.transform(F.array(F.lit(0)), lambda _: ml.finding("PasswordLike", F.lit(0), F.lit(4), 0.95, 2, 100, source="MachineLearning")).cast(f"array<{ml.FINDING}>")
    df = spark.createDataFrame([("zzzz quiet",)], "text string")
    assert not ml.classify_layered(df, model).first().result.is_sensitive
    on = ml.classify_layered(df, model, settings=Settings(ml_enabled=True)).first().result
    assert [(s.start, s.length) for s in on.plan] == [(0, 4)]


def test_model_gate(tmp_path):
    assert ml.model_gate(str(tmp_path)) == "NoPointer"
    (tmp_path / "current.json").write_text(json.dumps({"version": "1.0.0"}))
    assert ml.model_gate(str(tmp_path)) == "NoManifest"
    home = tmp_path / "versions" / "1.0.0"
    home.mkdir(parents=True)
    info = {"content_sha256": hashlib.sha256(b"m").hexdigest().upper(), "semver": "1.2.0", "evaluation": {"span_recall_overall": 0.9}}
    (home / "model.manifest.json").write_text(json.dumps(info))
    assert ml.model_gate(str(tmp_path)) == "NoModel"
    (home / "model.onnx").write_bytes(b"m")
    assert ml.model_gate(str(tmp_path)) == "Loaded"
    for change, status in (({"evaluation": {"span_recall_overall": 0.5}}, "RecallTooLow"), ({"semver": "2.0.0"}, "IncompatibleVersion"), ({"content_sha256": "x"}, "HashMismatch")):
        (home / "model.manifest.json").write_text(json.dumps(info | change))
        assert ml.model_gate(str(tmp_path)) == status


def test_tagged_text(spark):
    text = "a <PII>Bob B</PII>: <SECRET>x\ny</SECRET><PII></PII> <b>z</b> <PII>open"
    row = spark.createDataFrame([(text,)], "t string").select(T.parse_tagged(F.col("t")).alias("p")).first().p
    assert row.text == "a Bob B: x\ny <b>z</b> <PII>open"
    assert [(row.text[s.start : s.end], s.label) for s in row.spans] == [("Bob B", "PII"), ("x\ny", "SECRET"), ("", "PII")]


def test_subwords(spark):
    df = one(spark, tags="array('B-PII','O','B-SECRET')", words="array(null, 0, 0, 1, 2, 2, null)")
    row = df.select(T.align_subwords(F.col("tags"), F.col("words")).alias("a")).first()
    assert row.a == [-100, 3, 4, 0, 1, 2, -100]
    assert df.select(T.word_labels(T.align_subwords(F.col("tags"), F.col("words")), F.col("words")).alias("w")).first().w == [3, 0, 1]


def test_generated_text(spark):
    from maskwright.operators import generation as G

    rows = G.generate(G.templates(spark), 20).collect()
    assert len(rows) == 20 * len(G.TEMPLATES) and rows == G.generate(G.templates(spark), 20).collect()
    kinds = {"NETWORK": 0, "PII": 0, "SECRET": 0, "HOSTINFO": 0}
    for r in rows:
        assert "{IP" not in r.text and all(0 <= s.start < s.end <= len(r.text) for s in r.spans)
        for s in r.spans:
            kinds[s.label] += 1
    assert all(kinds.values())
    pairs = G.minimal_pairs(spark, 5).collect()
    assert len(pairs) == 60 and {len(p.spans) for p in pairs} == {0, 1}
    assert all(bool(p.spans) == bool(G.KINDS[p.kind]) for p in pairs)


def test_wordpiece_query_reads_whole_texts(spark, tmp_path):
    from maskwright.plans.relational import l_wordpiece

    rows = [(1, 0, "user", "q" * 3000), (1, 1, "user", "é " * 700), (2, 0, "user", None), (2, 1, "user", "The end.")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {(r.conv_id, r.turn): (r.n, r.unknown) for r in l_wordpiece(spark, str(tmp_path)).collect()}
    assert got == {(1, 0): (3002, 0), (1, 1): (702, 700), (2, 0): (2, 0), (2, 1): (7, 0)}
    vocab = ml.load_vocabulary(["[UNK]", "[CLS]", "[SEP]", "play"])
    capped = ml.tokenize(spark.createDataFrame([("play " * 50,)], "text string"), vocab, most=10).first().pieces
    assert len(capped.ids) == len(capped.offsets) == 10 and capped.ids[-1] == 2


def test_minimal_pairs_query_covers_its_table(spark):
    from maskwright.plans.relational import s_minimal_pairs

    d = "/root/testdata/sf0.001"
    keys = {r.p_partkey for r in spark.read.parquet(f"{d}/part.parquet").select("p_partkey").collect()}
    got = s_minimal_pairs(spark, d).collect()
    assert {r.n for r in got} == keys and len(got) == 12 * len(keys)


def test_manifest_digest_and_outside_share(spark):
    records = [(k % 3, [f"w{k % 7}", 'q"\\'], ["O", "B-PII" if k % 5 else "O"], ("train", "val")[k % 2]) for k in range(40)]
    df = spark.createDataFrame(records, "template_id int, tokens array<string>, tags array<string>, split string")
    digests = {r.split: r.digest for r in S.manifest(df).collect()}
    shares = {r.split: r.outside_percent for r in S.split_report(df).collect()}
    for split in ("train", "val"):
        mine = [r for r in records if r[3] == split]
        lines = [hashlib.sha256(json.dumps({"tokens": r[1], "tags": r[2]}, separators=(",", ":")).encode()).hexdigest() for r in mine]
        halves = (sum(int(x[a : a + 16], 16) for x in lines) for a in (0, 16))
        assert digests[split] == hashlib.sha256(":".join(map(str, halves)).encode()).hexdigest()
        assert shares[split] == round(100 * sum(t == "O" for r in mine for t in r[2]) / sum(len(r[2]) for r in mine), 2)
    assert {r.split: r.digest for r in S.manifest(df.orderBy(F.desc("tokens"))).collect()} == digests
    assert {r.split: r.digest for r in S.manifest(df.unionByName(df.limit(1))).collect()} != digests, "a repeated record counts"
    assert {tuple(r) for r in S.template_ids(df).collect()} == {(r[3], r[0]) for r in records}


def test_row_split_falls_back_to_all(spark):
    rows = spark.range(40).select(F.col("id").alias("k"))
    got = [r.split for r in S.row_split(rows.limit(1), F.col("k")).collect()]
    assert sorted(got) == ["test", "train", "val"] and S.row_split(rows.limit(0), F.col("k")).count() == 0


def test_inference_by_length_with_errors():
    import numpy as np

    calls = []

    def run(ids):
        calls.append(ids.shape)
        if (ids == 9).any():
            raise ValueError("nine")
        return np.stack([np.stack([row, row + 0.5], axis=1) for row in ids])

    found, errors = ml.infer_batches(run, [[1, 2], [3], [4, 5], [9, 1], [], [6]])
    assert found == [[[1, 1.5], [2, 2.5]], [[3, 3.5]], [[4, 4.5], [5, 5.5]], [], [], [[6, 6.5]]]
    assert errors == [None, None, None, "ValueError: nine", None, None] and (2, 1) in calls and (3, 2) in calls


def test_list_edit(spark):
    from maskwright.sources.store import edit_list

    df = one(spark, v="array(' a', 'a', '', 'b')")
    got = df.select(edit_list(F.col("v"), F.lit(" c ")).alias("x"), edit_list(F.col("v"), F.lit(" ")).alias("y"), edit_list(F.col("v"), remove=F.lit("a")).alias("z")).first()
    assert (got.x, got.y, got.z) == (["a", "b", "c"], ["a", "b"], ["b"])
