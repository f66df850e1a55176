"""Hand-computed vectors for single operators, and properties that hold whatever the data."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from lectern.functions import arrays as A
from lectern.functions import layout as L
from lectern.functions import text as X
from lectern.functions.bpe import decode_ids
from lectern.functions.edit import pseudo_cer, word_edit
from lectern.operators import confidence as C
from lectern.operators import evaluate as E
from lectern.operators import jobs as J
from lectern.plans import layout
from lectern.sources import files


def one(spark, col, **values):
    return spark.createDataFrame([Row(**(values or {"z": 1}))]).select(col.alias("r")).first()["r"]


def test_degenerate(spark):
    text = " ".join(f"EUV{i} (2017/19) ja" for i in range(200))
    d = one(spark, X.degenerate_stats(F.col("t"), F.octet_length("t")), t=text)
    assert (len(text), d["words"], d["distinct"], d["bad"]) == (3889, 600, 3, True)


@pytest.mark.parametrize("text,want", [("la " * 13 + "la", True), ("x" * 39, False), ("one two three four five six seven eight nine ten", False), ("abc " + "-" * 45, True), ("", False)])
def test_garbled(spark, text, want):
    assert one(spark, X.garbled(F.col("t")), t=text) is want


def test_parse_blocks_and_strip(spark):
    t = "x<|det|>text [1, 2, 3, 4]<|/det|> a b <|det|>title [5,6,7,8]<|/det|>c<|det|>bad<|/det|>"
    got = one(spark, X.parse_blocks(F.col("t")), t=t)
    assert [(b["type"], b["x0"], b["y1"], b["text"]) for b in got] == [("text", 1, 4, "a b"), ("title", 5, 8, "c<|det|>bad<|/det|>")]
    assert one(spark, X.strip_layout(F.col("t")), t=t + "<PAGE> d") == "x a b c d"


def test_edit_distance(spark):
    def plain(a, b):
        prev = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            cur = [i]
            for j, y in enumerate(b, 1):
                cur.append(min(prev[j] + 1, cur[-1] + 1, prev[j - 1] + (x != y)))
            prev = cur
        return prev[-1]

    r = np.random.default_rng(0)
    pairs = [("the cat sat on mat", "the cat sit on the mat"), ("", "a b"), ("a", ""), ("", ""), (" ".join(map(str, range(300))), " ".join(map(str, range(5, 310))))]
    pairs += [tuple(" ".join(str(x) for x in r.integers(0, 4 + 40 * (k % 2), r.integers(0, 30))) for _ in (0, 1)) for k in range(200)]
    rows = spark.createDataFrame([(k, *p) for k, p in enumerate(pairs)] + [(-1, None, "x y")], "k int, a string, b string").select("k", word_edit(F.col("a"), F.col("b")).alias("d"), pseudo_cer(F.col("a"), F.col("b")).alias("c")).collect()
    got = {x.k: x for x in rows}
    assert got[0].d == 2 and got[-1].d == 2
    for k, (a, b) in enumerate(pairs):
        n = len(b.split())
        assert got[k].d == plain(a.split(), b.split()) and abs(got[k].c - (min(1, got[k].d / n) if n else float(bool(a)))) < 1e-12


def trace(spark, p1, toks):
    rows = [(1, k + 1, float(p), 0.0, t == 1, t == 9) for k, (p, t) in enumerate(zip(p1, toks))]
    return spark.createDataFrame(rows, "stream long, step int, p1 double, ent double, eos boolean, newline boolean")


def test_page_features_with_windows_and_regions(spark):
    p = [0.95] * 30 + [0.3] * 10 + [0.9] * 20
    toks = [9 if k in (23, 48) else 5 for k in range(60)]
    f = C.page_features(trace(spark, p, toks)).first()
    assert f["ntok"] == 61 and f["p10"] == 0.3
    assert [round(f[c], 6) for c in ("conf", "lowf", "wminp")] == [0.827869, 0.163934, 0.715625]
    assert round(f["regp"], 6) == round(min(0.95, sum(p[24:49]) / 25), 6)


def test_page_is_cut_at_its_end(spark):
    f = C.page_features(trace(spark, [0.8, 0.4, 0.6, 0.2], [5, 6, 1, 7])).first()
    assert f["ntok"] == 4 and round(f["conf"], 6) == 0.7 and f["wminp"] == f["conf"]


def test_auroc_and_ranks(spark):
    d = spark.createDataFrame([("a", s, y) for s, y in zip([0.1, 0.4, 0.4, 0.8], [0, 0, 1, 1])], "g string, s double, y int")
    assert E.auroc(E.cells(d, "g", "s", "y"), "s", F.col("y"), "g").first()["auroc"] == 0.875
    assert E.auroc(E.cells(d.where("y = 1"), "g", "s", "y"), "s", F.col("y"), "g").first()["auroc"] is None
    assert E.auroc(E.cells(d.limit(0), "g", "s", "y"), "s", F.col("y"), "g").count() == 0


def test_measures_match_plain_python(spark):
    """Ties everywhere, one scorer of two values only, and one that is constant."""
    r = np.random.default_rng(3)
    pages = [(k, float(r.integers(0, 10)) / 10) for k in range(300)]
    scorers = {"many": lambda k, c: float(r.integers(0, 12)), "two": lambda k, c: float(c > 0.4) if k % 3 else 0.0, "flat": lambda k, c: 1.0}
    rows = [(k, c, n, f(k, c)) for k, c in pages for n, f in scorers.items()]
    d = spark.createDataFrame(rows, "page_id long, cer double, scorer string, score double")
    counts = E.cells(d, "scorer", "score", "cer")
    bad = (F.col("cer") > 0.5).cast("long")
    rho = {x.scorer: x.rho for x in E.spearman(counts, "score", "cer", "scorer").collect()}
    auc = {x.scorer: x.auroc for x in E.auroc(counts, "score", bad, "scorer").collect()}
    cover = {(x.scorer, x.fraction): x.caught for x in E.risk_coverage(d, counts, "score", bad, "scorer", "page_id").collect()}
    rank = lambda v: np.array([(np.sum(v < x) + (np.sum(v == x) + 1) / 2) for x in v])
    for name in scorers:
        s, c = (np.array([x[i] for x in rows if x[2] == name]) for i in (3, 1))
        y = c > 0.5
        a, b = rank(s) - rank(s).mean(), rank(c) - rank(c).mean()
        want = (a * b).sum() / np.sqrt((a * a).sum() * (b * b).sum()) if a.any() else 0.0
        assert abs(rho[name] - want) < 1e-9
        assert abs(auc[name] - (rank(s)[y].sum() - y.sum() * (y.sum() + 1) / 2) / (y.sum() * (~y).sum())) < 1e-9
        order = sorted(range(300), key=lambda i: -s[i])  # stable: equal scores in page order
        for f in E.FRACTIONS:
            assert abs(cover[name, f] - y[order[: max(1, round(f * 300))]].sum() / y.sum()) < 1e-9


def test_bootstrap_and_logistic_fit(spark):
    r = np.random.default_rng(4)
    x = r.normal(size=(400, 2)) * [1.0, 3.0] + [5.0, 0.0]
    y = (x[:, 0] - 5 + r.normal(size=400) * 0.5 > 0.6).astype(int)
    d = spark.createDataFrame([(k, float(a), float(b), int(c)) for k, ((a, b), c) in enumerate(zip(x, y))], "page_id long, a double, b double, y int")
    won = E.bootstrap_win(d, "page_id", F.col("a"), F.col("b"), F.col("y"), iterations=200).first()
    assert won["valid"] == 200 and won["a_wins"] == 200
    same = E.bootstrap_win(d, "page_id", F.col("a"), F.col("a"), F.col("y"), iterations=50).first()
    assert (same["a_wins"], same["valid"]) == (0, 50)
    assert E.bootstrap_win(d.where("y = 1"), "page_id", F.col("a"), F.col("b"), F.col("y"), iterations=5).first()["valid"] == 0
    fit = E.logistic_fit(d, ["a", "b"], F.col("y"))
    z, w, bias = (x - x.mean(axis=0)) / x.std(axis=0), np.zeros(2), 0.0
    for _ in range(4000):
        e = 1 / (1 + np.exp(-np.clip(z @ w + bias, -30, 30))) - y
        w, bias = w - 0.5 * (z.T @ e / 400 + 0.01 * w), bias - 0.5 * e.mean()
    assert np.allclose([f[1] for f in fit], [*w, bias], atol=1e-5)
    assert E.logistic_fit(d.where("y = 0"), ["a", "b"], F.col("y"))[-1][1] is None
    constant = E.logistic_fit(d.withColumn("b", F.lit(2.0)), ["a", "b"], F.col("y"))
    assert constant[1][3] == 1e-6 and abs(constant[1][1]) < 1e-9


@pytest.mark.parametrize("spec,want", [("3", (200, 3, None)), ("2,1", (200, None, [1, 0])), ("3,", (200, None, [2])), (",1", (400, None, None)), ("0", (400, None, None)), ("1,0", (400, None, None)), ("a", (400, None, None)), ("", (400, None, None))])
def test_page_spec(spark, spec, want):
    r = one(spark, J.page_spec(F.col("s")), s=spec)
    assert (r["status"], r["first"], r["list"]) == want


@pytest.mark.parametrize("w,h,want", [(612, 792, (3, 4, 1513)), (595, 842, (2, 3, 903)), (842, 595, (4, 3, 1503)), (960, 540, (7, 4, 3113)), (1000, 1000, (2, 2, 693)), (2000, 2000, (4, 4, 1913)), (100, 3200, (1, 32, 3793))])
def test_tile_choice(spark, w, h, want):
    t = one(spark, L.tile_choice(F.col("w"), F.col("h")), w=float(w), h=float(h))
    assert (t["w"], t["h"], t["h"] * 10 * (t["w"] * 10 + 1) + 273) == want
    assert len(L.tilings()) == 118


def test_letterbox_and_boxes(spark):
    assert tuple(one(spark, L.letterbox(F.lit(1020.0), F.lit(1320.0)))) == (791, 1024, 116, 0)
    box = F.array(*L.unproject(F.lit(612.0), F.lit(792.0), [F.lit(x) for x in (200, 100, 800, 500)]))
    assert [round(x, 6) for x in one(spark, box)] == [68.4, 79.2, 543.6, 396.0]


def test_softmax_entropy_and_int4(spark):
    e = one(spark, A.softmax_entropy(F.col("x"), F.array_max("x")), x=[1.0, 2.0, 3.0])
    assert (round(e["p1"], 6), round(e["entropy"], 6)) == (0.665241, 0.832396)
    q = one(spark, A.quant_int4(F.col("x"), 5), x=[7.0, -3.5, 1.5, 0.5, 0.0])[0]
    assert q["scale"] == 1 and q["codes"] == [7, -4, 2, 0, 0]


def test_fp8_table_and_gelu(spark):
    v = A.fp8_values()
    assert v[0] == 0 and v[126] == 448 and v[8] == 2.0**-6 and np.isnan(v[127]) and (np.diff(v[:127]) > 0).all()
    assert one(spark, A.fp8_codes(F.col("x")), x=[448.0, -448.0, 0.0]) == [126, 254, 0]
    assert [round(x, 5) for x in one(spark, A.gelu(F.col("x")), x=[0.0, 1.0, -1.0])] == [0.0, 0.84134, -0.15866]


def test_bpe_decode_drops_unknown_ids_and_splits_characters(spark):
    vocabulary = spark.createDataFrame([(2, "a"), (3, "Ã"), (4, "©"), (5, "Ġ")], "tok int, piece string")
    tokens = spark.createDataFrame([(1, 0, 2), (1, 1, 5), (1, 2, 3), (1, 3, 4), (1, 4, 99), (1, 5, 1), (2, 0, 1)], "page_id long, pos int, tok int")
    assert {r["page_id"]: r["text"] for r in decode_ids(tokens, vocabulary).collect()} == {1: "a é", 2: ""}


def test_bpe_decode_shuffles_tokens_once_and_keeps_equal_and_null_pages(spark, tmp_path):
    vocabulary = spark.createDataFrame([(2, "a"), (3, "b"), (4, None)], "tok int, piece string")
    tokens = spark.createDataFrame([(None, 1, 3), (None, 0, 2), (1, 0, 4), (1, 1, 3), (1, 2, None), (2, 0, 1)], "page_id long, pos int, tok int")
    assert {r["page_id"]: r["text"] for r in decode_ids(tokens, vocabulary).collect()} == {None: "ab", 1: "b", 2: ""}
    plan = decode_ids(tokens, vocabulary)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning") == 1 and "ObjectHashAggregate" not in plan
    mixed = spark.createDataFrame([(k % 2, 30000 - k, 2 + k // 2 % 2) for k in range(30000)], "page_id long, pos int, tok int").coalesce(1)  # pages and places in no order
    assert {r["page_id"]: r["text"] for r in decode_ids(mixed, vocabulary).collect()} == {k: "".join("ab"[j // 2 % 2] for j in reversed(range(30000)) if j % 2 == k) for k in (0, 1)}
    # a page of several batches, two turns of one number, and a turn without one
    rows = [(1, 1, "u", "é𝄞 " * 9000), (1, 1, "u", "other"), (None, 2, "u", "x"), (2, 0, "u", None)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = sorted(map(str, map(tuple, layout.bpe_decode(spark, str(tmp_path)).collect())))
    want = [(c and c * 1000 + n, len(t or ""), hashlib.md5((t or "").encode()).hexdigest()) for c, n, _, t in rows]
    assert got == sorted(map(str, want))


def test_manifest_and_safetensors(spark, tmp_path):
    import json
    import struct

    (tmp_path / "m.tsv").write_text("# safetensors=x\nb\tF32\t2,3\t100\t24\na\tBF16\t\t124\t2\n")
    assert [(r["name"], r["shape"]) for r in files.read_manifest(spark, str(tmp_path / "m.tsv")).collect()] == [("b", [2, 3]), ("a", [])]
    head = json.dumps({"z": {"dtype": "F32", "shape": [2], "data_offsets": [0, 8]}, "a": {"dtype": "F32", "shape": [], "data_offsets": [8, 12]}, "__metadata__": {}}).encode()
    (tmp_path / "w.safetensors").write_bytes(struct.pack("<Q", len(head)) + head + b"\0" * 12)
    spark.dataSource.register(files.SafetensorsSource)
    rows = spark.read.format("safetensors").load(str(tmp_path / "w.safetensors")).collect()
    assert [(r["name"], r["offset"] - 8 - len(head), r["nbytes"]) for r in rows] == [("a", 8, 4), ("z", 0, 8)]


def test_file_sources_and_sinks(spark, tmp_path):
    (tmp_path / "out").mkdir()
    (tmp_path / "out/a.txt").write_text("log\n===== OCR (2 page(s), 31 tokens) =====\n<PAGE>x<|det|>text [1, 2, 3, 4]<|/det|> a <|det|> b\n<PAGE><|det|>title [5, 6, 7, 8]<|/det|>c")
    (tmp_path / "out/b.txt").write_text("no output")
    got = {r["path"][-5:]: r for r in files.read_engine_output(spark, str(tmp_path / "out")).withColumn("blocks", X.parse_strict(F.col("body"))).collect()}
    a = got["a.txt"]
    assert (a["pages"], a["tokens"]) == (2, 31) and [[(b["type"], b["x0"], b["text"]) for b in p] for p in a["blocks"]] == [[("text", 1, "a <|det|> b")], [("title", 5, "c")]]
    assert got["b.txt"]["pages"] is None and got["b.txt"]["body"] is None
    (tmp_path / "cache.json").write_text('{"d/3/base": {"text": "x", "conf": 0.5, "ntok": 7}, "d/3/hires": {"text": "y", "risk": 0.1}}')
    rows = {r["mode"]: r for r in files.read_eval_cache(spark, str(tmp_path / "cache.json")).collect()}
    assert rows["base"]["page"] == 3 and rows["base"]["ntok"] == 7 and rows["hires"]["conf"] is None and rows["hires"]["risk"] == 0.1
    (tmp_path / "f.bin").write_bytes(np.array([1.5, -2.0], "<f4").tobytes())
    assert files.read_f32(spark, str(tmp_path / "f.bin")).first()["values"] == [1.5, -2.0]
    (tmp_path / "d.pdf").write_bytes(b"%PDF-1.4\n<< /Type /Pages /Count 2 >> << /Type /Pages /Kids [] /Count  14 >>")
    (tmp_path / "e.pdf").write_bytes(b"no document /Count 3")
    n = {r["path"][-5:]: r["n_pages"] for r in files.read_documents(spark, str(tmp_path / "*.pdf")).collect()}
    assert n == {"d.pdf": 14, "e.pdf": None}
    d = spark.createDataFrame([(2, "b"), (1, "a,\"x")], "n int, line string")
    files.write_csv(d, str(tmp_path / "csv"))
    assert sorted(map(tuple, spark.read.csv(str(tmp_path / "csv"), header=True, escape='"').collect())) == sorted([("1", 'a,"x'), ("2", "b")])
    files.write_report(d, str(tmp_path / "report"), "n")
    assert [r[0] for r in spark.read.text(str(tmp_path / "report")).collect()] == ['a,"x', "b"]
    files.write_json(d, str(tmp_path / "json"))
    assert {r["n"]: r["line"] for r in spark.read.json(str(tmp_path / "json")).collect()} == {1: 'a,"x', 2: "b"}


def test_missing_tensor_is_an_error(spark):
    manifest = spark.createDataFrame([("a", 1), ("b", 2)], "name string, nbytes long")
    names = spark.createDataFrame([("b",), ("a",)], "name string")
    assert files.lookup(names, manifest).count() == 2
    with pytest.raises(Exception, match="missing tensor c"):
        files.lookup(names.unionByName(spark.createDataFrame([("c",)], "name string")), manifest).collect()


def test_viewer_parse_is_tolerant(spark):
    t = " <PAGE> <PAGE>z<|det|> text [ 1 , 2,3 , 4 ]<|/det|> a <|det|>bad<|det|>title [5,6,7,8]<|/det|>c"
    pages = one(spark, X.parse_viewer(F.col("t")), t=t)
    assert [[(b["type"], b["y1"], b["text"]) for b in p] for p in pages] == [[("text", 4, "a"), ("title", 8, "c")]]


def test_retry_merge_is_idempotent(spark):
    d = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (2, 1, "c")], "k int, pass int, t string")
    once = J.retry_merge(d, ["k"], "pass")
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, J.retry_merge(once, ["k"], "pass").collect())) == [(1, 2, "b"), (2, 1, "c")]


def test_results_do_not_depend_on_partitioning(spark):
    d = spark.range(2000).select(F.lit("g").alias("g"), (F.col("id") % 37 / 37.0).alias("s"), (F.col("id") % 5 == 0).cast("int").alias("y"))
    got = {round(E.auroc(E.cells(x, "g", "s", "y"), "s", F.col("y"), "g").first()["auroc"], 12) for x in (d, d.repartition(7), d.orderBy(F.rand(1)))}
    assert len(got) == 1


def test_image_kernels():
    from lectern.functions import pixels as P

    image = np.arange(12.0).reshape(3, 4)
    assert np.allclose(P.resize_bilinear(image, 3, 4), image)
    assert P.letterbox(np.full((10, 20), 127.5 * 2), 16).shape == (16, 16) and P.letterbox(image, 8)[0, 0] == 127 / 127.5 - 1
    assert P.im2col(np.arange(16.0).reshape(4, 4), 2, 2).tolist() == [[0, 1, 4, 5], [2, 3, 6, 7], [8, 9, 12, 13], [10, 11, 14, 15]]
    assert np.allclose(P.convolve(image, np.eye(3) * [[0, 0, 0], [0, 1, 0], [0, 0, 0]]), image)
    table = np.arange(5.0)[:, None]
    assert P.relative_positions(3, table)[:, :, 0].tolist() == [[2, 1, 0], [3, 2, 1], [4, 3, 2]]
    assert np.allclose(P.cubic_weights(6, 6), np.eye(6)) and np.allclose(P.resize_bicubic(np.full((2, 8, 8), 3.0), 5, 11), 3.0)
    assert P.relative_positions(4, table).shape == (4, 4, 1) and len(P.interpolate(table, 9)) == 9


def test_entry_lists_every_query_with_matching_names():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and len(e.queries()) > 100
