"""Near-duplicates, archives, tokens, packing, decontamination, classifiers and the pipeline against brute force."""

import collections
import gc
import hashlib
import io
import random
import re
import time
import weakref
import zlib
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lectern.llm import common, components, decontaminate, id_coder, language_id, packing, quality_cnn, queries, secrets, simhash, token_file, tokens, warc

SF = "/root/testdata/sf0.001"


def fingerprint(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    h = [xxhash.xxh64_intdigest(" ".join(g).encode(), 42) for g in ([w[i : i + 3] for i in range(len(w) - 2)] or ([w] if w else []))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def roots(ids, linked):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in ids:
        for b in ids:
            if a < b and linked(a, b) and find(a) != find(b):
                parent[max(find(a), find(b))] = min(find(a), find(b))
    return {i: find(i) for i in ids}


def test_simhash_matches_brute_force(spark, frame, tables):
    r = random.Random(0)
    base = [" ".join(r.choice("abcdefgh") * 3 + str(r.randrange(50)) for _ in range(300)) for _ in range(12)]
    texts = {}
    for k in range(150):
        words = r.choice(base).split()
        for _ in range(r.choice([0, 0, 1, 2, 6])):
            words[r.randrange(len(words))] = "Edit"
        texts[k] = " ".join(words)
    texts |= {200: None, 201: "", 202: "\t\n", 203: "one two", 204: "One TWO", 205: "É x y z", 206: "w " * 50000}
    rows = queries.op2_simhash(spark, tables(documents=frame(list(texts.items())))).collect()
    prints = {k: fingerprint(t) for k, t in texts.items()}
    want = roots(sorted(texts), lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 2)
    assert {x.doc_id: (x.fingerprint, x.component_id) for x in rows} == {k: (f"{prints[k]:016x}", want[k]) for k in texts}


def five_words(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    return {" ".join(w[i : i + 5]) for i in range(len(w) - 4)} or ({" ".join(w)} if w else set())


def similar_roots(texts):
    """Groups by brute force: fingerprints of five-word shingles two bits apart, or sets of these at least 0.8 similar."""
    sets = {k: five_words(t) for k, t in texts.items()}
    prints = {k: simhash.fingerprint((t or "").encode(), 5) for k, t in texts.items()}
    alike = lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 2 or bool(sets[a] and sets[b]) and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])
    return roots(sorted(texts), alike)


def test_near_copies_match_brute_force(spark, frame):
    r = random.Random(21)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randrange(2, 8)))
    base = [[word() for _ in range(r.choice([6, 40, 200, 400]))] for _ in range(30)]
    passage = " ".join(word() for _ in range(60))  # many texts share it, whose own words differ
    texts = {}
    for k in range(260):
        words = list(r.choice(base))
        for _ in range(r.choice([0, 0, 1, 2, 4, 8, 16]) * len(words) // 400 + r.choice([0, 0, 1])):
            words[r.randrange(len(words))] = "edit"
        texts[k] = " ".join(words)
    texts |= {1000 + k: passage + " " + " ".join(word() for _ in range(10 + k % 5)) for k in range(80)}
    texts |= {2000: None, 2001: "", 2002: " \n", 2003: "one two", 2004: "One TWO", 2005: "w " * 50000}
    want = similar_roots(texts)
    docs = frame(list(texts.items()) + [(None, "one two"), (3, texts[3])]).withColumnRenamed("start", "gone")
    kept = simhash.keep_one_each(docs)
    assert kept.columns == docs.columns
    ids = [x["doc_id"] for x in kept.collect()]
    assert {k for k in ids if k is not None} == set(want.values()) and ids.count(None) == 1
    assert ids.count(3) == (2 if want[3] == 3 else 0)
    exact_only = roots(sorted(texts), lambda a, b: five_words(texts[a]) == five_words(texts[b]))
    assert len(set(want.values())) < len(set(exact_only.values())) - 10  # the samples found many that only resemble each other
    assert simhash.keep_one_each(frame([])).count() == 0


def test_no_pair_at_the_threshold_is_missed(frame):
    r = random.Random(5)
    texts = {}
    for k in range(1500):  # 16 of 20 shingles in common
        words = [f"{r.randrange(10**6)}" for _ in range(22)]
        texts |= {2 * k: " ".join(words), 2 * k + 1: " ".join([*words[:20], "other", "end"])}
    # many meet at a passage, only pairs of which are similar, and the first by id is like none
    passage = [f"p{k}" for k in range(40)]
    for k in range(40):
        own = [f"{r.randrange(10**6)}" for _ in range(20)]
        texts |= {10000 + 2 * k: " ".join(passage + own), 10001 + 2 * k: " ".join([*passage, *own[:18], "x", "y"])}
    kept = {x["doc_id"] for x in simhash.keep_one_each(frame([*texts.items(), (9999, " ".join(passage))])).collect()}
    assert kept == {k for k in texts if k % 2 == 0} | {9999}


def test_parities_never_rule_out_a_similar_pair():
    r = np.random.default_rng(3)
    for _ in range(300):
        n, m = r.integers(1, 1500, 2)
        pool = r.integers(0, 1 << 64, n + m, dtype=np.uint64)
        at = r.integers(0, n)
        x, y = pool[:n], pool[at : at + m]
        odd = simhash.apart(simhash.parities(x), simhash.parities(y))
        assert odd <= len(set(x.tolist()) ^ set(y.tolist())) and odd % 2 == (n + m) % 2
    assert simhash.apart(simhash.parities(pool), simhash.parities(pool[::-1])) == 0


def test_only_pairs_that_may_be_similar_are_compared_whole(frame, monkeypatch):
    r = random.Random(14)
    own = lambda n: " ".join(f"{r.randrange(10**6)}" for _ in range(n))
    passage = own(130)  # so long that all meet at it, but none for it is 0.8 similar to another
    texts = {k: f"{passage} {own(30)}" for k in range(60)}
    texts |= {100 + k: texts[k] + " end" for k in range(5)}
    seen, verified = [], simhash._verified
    monkeypatch.setattr(simhash, "_verified", lambda docs, pairs, *rest: seen.append({(x.rep1, x.rep2) for x in pairs.collect()}) or verified(docs, pairs, *rest))
    assert {x["doc_id"] for x in simhash.keep_one_each(frame(list(texts.items()))).collect()} == set(range(60))
    whole = set().union(*seen)
    assert whole >= {(k, 100 + k) for k in range(5)} and len(whole) < 20


def test_settled_tables_leave_no_shuffle_files(spark):
    manager = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files = lambda: {str(f) for d in manager.localDirsString() for f in Path(d).rglob("shuffle_*")}
    before, rows = files(), spark.range(50000).groupBy((F.col("id") * 7 % 20011).alias("k")).count()
    assert len(common.settle(rows, "counts").collect()) == 20011
    end = time.time() + 15  # they are deleted in the background
    while (left := files() - before) and time.time() < end:
        time.sleep(0.2)
    assert not left


def test_fingerprint_of_long_texts_counts_every_shingle(monkeypatch):
    r = random.Random(13)
    text = " ".join(f"{k}x{r.randrange(10**6)}" for k in range(110000))
    words = text.split()
    prints = np.array([xxhash.xxh64_intdigest(" ".join(words[i : i + 3]), 42) for i in range(len(words) - 2)], "<u8")
    ones = np.unpackbits(prints.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    assert simhash.fingerprint(text.encode()) == sum(1 << b for b in range(64) if 2 * ones[b] > len(prints))
    monkeypatch.setattr(simhash, "BLOCK", 8)  # many block ends, so that a shingle lost at each shows
    for n in range(3, 200):
        part = " ".join(words[:n])
        assert simhash.fingerprint(part.encode()) == fingerprint(part)


def test_simhash_null_and_repeated_ids(frame):
    rows = simhash.near_duplicates(frame([(None, "lonely words here"), (None, "a b c d"), (4, "a b c d"), (4, "a b c d"), (2, "a b c d")])).collect()
    assert sorted((x.doc_id or -1, x.component_id or -1) for x in rows) == [(-1, -1), (-1, 2), (2, 2), (4, 2), (4, 2)]
    assert simhash.near_duplicates(frame([])).count() == 0


def test_components_of_chains_stars_and_loops(spark):
    links = [(k, k + 1) for k in range(200)] + [(1000, 1000 + k) for k in range(300)] + [(5, 5), (None, 3), (2000, 2001), (2001, 2000), (2000, 2001)]
    got = dict(map(tuple, components.connected_components(spark.createDataFrame(links, "a long, b long")).collect()))
    assert got == {k: 0 for k in range(201)} | {1000 + k: 1000 for k in range(300)} | {2000: 2000, 2001: 2000}


def test_warc_round_trip(spark, tables):
    rows = [(1, "a\nb", None), (2, None, ""), (3, "u", "x" * 200), (4, "u", "x" * 200), (4, "u", "x" * 200), (3, "u", "x" * 200), (5, "é", "x" * 99), (6, "u", "x" * 99), (None, "u", "x" * 200), (7, "u", "y" * 3000000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = queries.op5_warc(spark, tables(pages=pages)).collect()
    want = []
    for page, _, html in rows:
        data = (html or "").encode()
        first = min((p for p, _, h in rows if p is not None and h == html), default=None)
        again = len(data) >= 100 and page is not None and page > first
        want.append((page, len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", first if again else None))
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    directory = warc.archive_directory(spark)
    back = warc.read_archives(warc.write_archives(pages, directory), directory, with_payload=True).where("page_id = 7").first()
    assert back["payload"] == b"y" * 3000000
    assert warc.read_archives(warc.write_archives(pages.limit(0), directory + "x"), directory + "x").count() == 0


def test_warc_damage_is_seen():
    records = [warc.record(k, "http://x", f"payload {k}".encode() * 50, hashlib.sha256(f"payload {k}".encode() * 50).hexdigest(), None, "2024-01-01T00:00:00Z") for k in range(40)]
    d = warc.dictionary(records)
    import zstandard

    pack = zstandard.ZstdCompressor(dict_data=d, write_checksum=True)
    data = d.as_bytes()
    whole = warc.DICT_MAGIC + len(data).to_bytes(4, "little") + data + b"".join(pack.compress(r) for r in records)
    assert len(list(warc.parse(warc.open_archive(io.BytesIO(whole))))) == 40
    broken = bytearray(whole)
    broken[-20] ^= 255
    with pytest.raises((zstandard.ZstdError, ValueError)):
        list(warc.parse(warc.open_archive(io.BytesIO(bytes(broken)))))


@pytest.mark.parametrize("as_text", [False, True])
@pytest.mark.parametrize("name,lower", [("word_bpe_49k.json", True), ("byte_bpe_50k.json", False)])
def test_word_cache_equals_whole_texts(name, lower, as_text):
    r = random.Random(3)
    bits = ["a", "b'", "s ", "  ", "\n", " \n", "é", "é", "1", "2 ", " ", " ", "Σ", "ΑΣ ", "İ", "..", "\t", "𝄞", " ́", "\x1f ", "can't", "I'LL ", "a.", "a,\n", "b.\nC", "'s.", "\r\n", "<|endoftext|>", "<|startoftext|>", "<|EndOfText|>", "<|", "\x00", "1.", ", ", "\n\n", "\n\n ", "\n\t", "$$$ ", "-", "\n#"]
    texts = ["".join(r.choice(bits) for _ in range(r.randrange(0, 30))) for _ in range(3000)] + ["", None, "x" * 20000]
    whole = Tokenizer.from_file(public_tokenizers.path(name))
    whole.encode_special_tokens = as_text
    cache = tokens.WordCache(public_tokenizers.path(name), lower, as_text)
    cache.MOST = 500
    for at in range(0, len(texts), 100):
        part = texts[at : at + 100]
        assert [x.tolist() for x in cache.encode(part)] == [whole.encode(t or "", add_special_tokens=False).ids for t in part]


@pytest.mark.parametrize("blocks,lanes,steps", [(1, 1, 1), (1, 3, 50), (3, 40, 100), (2, 5, 512)])
def test_id_coder_round_trip(blocks, lanes, steps):
    r = np.random.default_rng(0)
    n = blocks, lanes * steps
    for x in (r.integers(0, 65535, n), r.integers(0, 5, n), np.minimum(r.geometric(0.01, n) * 37, 65534), np.full(n, 65534), np.zeros(n, int)):
        coded = id_coder.encode(x, steps)
        assert (id_coder.decode(coded, lanes, steps) == x).all()
        # a block is decoded from its own bytes, and coded without the others
        for row, block in zip(x, coded):
            assert (id_coder.decode([block], lanes, steps)[0] == row).all() and id_coder.encode(row[None], steps) == [block]
    with pytest.raises(ValueError):
        id_coder.encode(np.full((1, 8), 65535), 8)


def test_id_coder_learns():
    x = np.tile(np.arange(100) * 311 % 40000, (4, 20))
    assert sum(map(len, id_coder.encode(x, 2000))) * 8 / x.size < 4


def test_id_coder_is_below_the_order_0_entropy():
    texts = pq.read_table("/root/testdata/sf0.1/documents.parquet", columns=["text"])["text"].to_pylist()[:4000]
    ids = tokens.WordCache(public_tokenizers.path("byte_bpe_50k.json")).encode(texts, 2)
    n = np.bincount(np.concatenate(ids))
    p = n[n > 0] / n.sum()
    assert len(token_file.pack_segment(list(range(len(ids))), ids)) * 8 / n.sum() < 0.9 * -(p * np.log2(p)).sum()


def test_token_file_matches_tokenizer(spark, frame, tables):
    docs = {5: None, 3: "", 9: "a  b \n c", 1: "x" * 5000, 12: "The quick brown fox. " * 400, 20: "see <|endoftext|> here"}
    rows = {x.doc_id: x for x in queries.op7_token_file(spark, tables(documents=frame(list(docs.items())))).collect()}
    whole, at = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), 0
    for k in sorted(docs):
        ids = np.array([*whole.encode(docs[k] or "", add_special_tokens=False).ids, 2], "<u4")
        assert (rows[k].start, rows[k].n_tokens, rows[k].ids_crc32) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)


def test_token_file_damage_and_empty(spark, frame):
    segment = token_file.MAGIC + token_file.pack_segment([1, None, 3], [np.arange(700, dtype=np.uint32), np.zeros(0, np.uint32), np.arange(5, dtype=np.uint32)])
    (ids, parts), = token_file.unpack_segments(io.BytesIO(segment))
    assert ids == [1, None, 3] and [len(p) for p in parts] == [700, 0, 5] and parts[0].tolist() == list(range(700))
    broken = bytearray(segment)
    broken[-3] ^= 255
    broken[-200] ^= 255
    with pytest.raises(ValueError):
        list(token_file.unpack_segments(io.BytesIO(bytes(broken))))
    directory = token_file.id_directory(spark)
    assert token_file.read_ids(token_file.write_ids(frame([]), directory, public_tokenizers.path("byte_bpe_50k.json")), directory).count() == 0


def first_fit_check(rows, size=2048):
    at = collections.defaultdict(list)
    for x in rows:
        at[x.sequence_id].append((x.offset, x.length))
    for parts in at.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= size
    return len(at)


def test_packing_pieces_and_places(spark, frame, tables):
    r = random.Random(6)
    docs = {k: " ".join(r.choice(["thing", "of", "whenever"]) for _ in range(r.choice([3, 200, 900, 2500]))) for k in range(120)} | {200: None, 201: "", 202: "a <|startoftext|> b <|endoftext|>"}
    rows = queries.op8_packing(spark, tables(documents=frame(list(docs.items())))).collect()
    whole, want, total = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), {}, 0
    for k, t in docs.items():
        ids = np.array([*whole.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        total += len(ids)
        want |= {(k, i): (a, len(ids[a : a + 2048]), zlib.crc32(ids[a : a + 2048].tobytes())) for i, a in enumerate(range(0, len(ids), 2048))}
    assert {(x.doc_id, x.piece): (x.start, x.length, x.ids_crc32) for x in rows} == want
    assert first_fit_check(rows) <= -(-total // 2048) + 2


def test_pipeline_returns_the_packed_ids(spark, frame):
    import corpus_pipeline

    docs = {1: "thing of whenever", 2: "of " * 3000, 3: None}
    rows = corpus_pipeline.packed(spark, frame(list(docs.items())), SF).collect()
    whole = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for k, t in docs.items():
        parts = [x for _, x in sorted((x.piece, x) for x in rows if x.doc_id == k)]
        assert [int(i) for x in parts for i in np.frombuffer(x.ids, "<u2")] == [*whole.encode(t or "", add_special_tokens=False).ids, 0]
        assert all(len(x.ids) == 2 * x.length and zlib.crc32(np.frombuffer(x.ids, "<u2").astype("<u4").tobytes()) == x.ids_crc32 for x in parts)
    first_fit_check(rows)


def test_packing_null_and_repeated_ids_and_empty_table(frame):
    path = public_tokenizers.path("word_bpe_49k.json")
    rows = [(None, "a b"), (None, None), (3, "a b"), (3, "a b"), (3, "c " * 5000)]
    got = packing.pack(packing.pieces(frame(rows).repartition(3), path), packing.id_type(path)).collect()
    assert sorted((x.doc_id or -1, x.piece, x.length) for x in got) == [(-1, 0, 1), (-1, 0, 3), (3, 0, 3), (3, 0, 3), (3, 0, 2048), (3, 1, 2048), (3, 2, 905)]
    first_fit_check(got)
    assert packing.pack(packing.pieces(frame([]), path), packing.id_type(path)).count() == 0


def test_packing_moves_no_ids(spark, frame):
    path = public_tokenizers.path("word_bpe_49k.json")
    docs = frame([(k, "of " * (k % 7)) for k in range(400)]).repartition(9)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as if the counts were too large to send
    try:
        got = packing.pack(packing.pieces(docs, path), packing.id_type(path))
        assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    rows = got.collect()
    assert len(rows) == 400 and len({(x.sequence_id, x.offset) for x in rows}) == 400
    first_fit_check(rows)


def test_packing_places_without_reading_ids_and_takes_few_texts_at_once(spark, frame, monkeypatch):
    path = public_tokenizers.path("word_bpe_49k.json")
    docs, settled = frame([(k, "of " * (k % 3000)) for k in range(3000)]), []
    settle = packing.settle
    monkeypatch.setattr(packing, "settle", lambda df, name, conf: settled.append(conf) or settle(df, name, conf))
    cut = packing.pieces(docs, path)
    got = packing.pack(cut, packing.id_type(path), with_ids=False)
    assert "ids" not in got.columns and "ids:binary" not in got._jdf.queryExecution().executedPlan().toString()
    with_ids = packing.pack(packing.pieces(docs, path), packing.id_type(path))
    assert sorted(map(tuple, got.collect())) == sorted(x[:7] for x in map(tuple, with_ids.collect()))
    assert all(c["spark.sql.execution.arrow.maxRecordsPerBatch"] < 1000 for c in settled) and len(settled) == 2
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000"


def test_a_worker_lets_go_of_what_other_stages_kept():
    gc.disable()
    try:
        words = weakref.ref(tokens.word_cache(public_tokenizers.path("word_bpe_49k.json"), True))
        common.kept("finder")["of a test"] = 1
        common.let_go("words")
        assert words() is tokens.word_cache(public_tokenizers.path("word_bpe_49k.json"), True) and not common.kept("finder")
        common.let_go()
        assert words() is None
    finally:
        gc.enable()


def test_stages_take_few_texts_at_once(spark, frame, monkeypatch):
    import corpus_pipeline

    taken, settle = {}, common.settle
    for part in (simhash, secrets, packing):
        monkeypatch.setattr(part, "settle", lambda df, name, conf=None: taken.update({name: (conf or {}).get("spark.sql.execution.arrow.maxRecordsPerBatch", 10_000)}) or settle(df, name, conf))
    docs = frame([(1, "a b c d e f"), (2, "a b c d e f"), (3, "g h i j k l")])
    assert {x["doc_id"] for x in corpus_pipeline.near_dedup(spark, docs, SF).collect()} == {1, 3}
    assert corpus_pipeline.without_secrets(spark, docs, SF).count() == corpus_pipeline.packed(spark, docs, SF).count() == 3
    assert all(taken[name] < 1000 for name in ("sketches", "sets", "able", "verified", "secrets", "pieces"))
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000"


def test_token_files_take_few_texts_at_once(frame, tmp_path, monkeypatch):
    taken, settle = [], common.settle
    monkeypatch.setattr(token_file, "settle", lambda df, name, conf=None: taken.append(conf or {}) or settle(df, name, conf))
    path, docs = public_tokenizers.path("byte_bpe_50k.json"), [(k, f"word {k}") for k in range(1200)]
    rows = token_file.read_ids(token_file.write_ids(frame(docs), f"file://{tmp_path}/ids", path, parts=1), f"file://{tmp_path}/ids", with_ids=True).collect()
    whole = Tokenizer.from_file(path)
    assert [(x["doc_id"], x["ids"]) for x in rows] == [(k, [*whole.encode(t, add_special_tokens=False).ids, 2]) for k, t in docs]
    assert [c["spark.sql.execution.arrow.maxRecordsPerBatch"] < 1000 for c in taken] == [True]


def plain_best_fit(lengths, size):
    rooms = []
    for x in sorted(lengths, reverse=True):
        best = min((k for k, room in enumerate(rooms) if room >= x), key=lambda k: rooms[k], default=None)
        if best is None:
            rooms.append(size - x)
        else:
            rooms[best] -= x
    return len(rooms)


def test_plan_equals_best_fit_of_single_pieces():
    r = random.Random(7)
    for _ in range(60):
        lengths = [r.randint(1, 60) for _ in range(r.randrange(1, 200))]
        shapes = packing.plan(collections.Counter(lengths), 60)
        assert sorted(x for n, s in shapes for _ in range(n) for x in s) == sorted(lengths)
        assert all(sum(s) <= 60 for _, s in shapes) and sum(n for n, _ in shapes) == plain_best_fit(lengths, 60)


def semi_global(p, t):
    prev = [0] * (len(t) + 1)
    for i, a in enumerate(p, 1):
        cur = [i]
        for j, b in enumerate(t, 1):
            cur.append(min(prev[j] + 1, cur[-1] + 1, prev[j - 1] + (a != b)))
        prev = cur
    return min(prev), prev.index(min(prev))


def test_bit_parallel_distance():
    r = random.Random(8)
    for _ in range(400):
        p, t = ("".join(r.choice("abc") for _ in range(r.randrange(lo, 20))) for lo in (1, 0))
        assert decontaminate.Pattern(p).best(t) == semi_global(p, t)


def test_leaks_match_brute_force(spark, frame):
    r = random.Random(9)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randrange(2, 7)))
    items = [(k, " ".join(word() for _ in range(r.randrange(4, 12))).capitalize()) for k in range(12)] + [(50, None), (51, " \n "), (52, "zz")]
    docs = [(500, None), (501, ""), (502, "nothing")]
    for k in range(150):
        text = list(" ".join(word() for _ in range(30)))
        if k % 3:
            x = list(r.choice(items[:12])[1].upper() if k % 2 else r.choice(items[:12])[1].replace(" ", "\n  "))
            for _ in range(r.randrange(0, 7)):
                x[r.randrange(len(x))] = r.choice(["", "q", "qq"])
            text[r.randrange(len(text)) : 0] = [" ", *x, " "]
        docs.append((k, "".join(text)))
    got = {(x.doc_id, x.item_id): x for x in decontaminate.find_leaks(frame(docs), spark.createDataFrame(items, "item_id long, text string")).collect()}
    norm = decontaminate.normalise
    want = {(d, i): semi_global(norm(p), norm(t))[0] for d, t in docs if t and norm(t) for i, p in items if p and norm(p)}
    budget = {i: int(len(norm(p)) * decontaminate.ERROR_RATE) for i, p in items if p}
    assert {k: x.distance for k, x in got.items()} == {k: v for k, v in want.items() if v <= budget[k[1]]}
    texts = dict(docs)
    for (d, i), x in got.items():
        assert semi_global(norm(dict(items)[i]), norm(texts[d][x.start : x.end]))[0] <= x.distance
    left = {x["doc_id"] for x in decontaminate.drop_leaks(frame(docs), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert left == {d for d, _ in docs} - {d for d, _ in got}


def test_items_are_searched_in_blocks(spark, frame, monkeypatch):
    items = spark.createDataFrame([(k, f"item number {k} with some words") for k in range(40)], "item_id long, text string")
    blocks = list(decontaminate.blocks(items, "item_id", "text", most=300))
    assert len(blocks) > 2 and sorted(i for b in blocks for i, _ in b) == list(range(40))


def test_networks_gradients():
    r = np.random.default_rng(0)
    net = language_id.Network(*[w.astype(np.float64) for w in language_id.Network.fresh(["a", "b", "c"], 3, 1).weights()], ["a", "b", "c"])
    x, y = r.integers(0, 5, (4, 7)).astype(np.uint8), np.array([0, 1, 2, 1])
    cnn = quality_cnn.Network.fresh(1)
    cnn.table, cnn.bias, cnn.head = (w.astype(np.float64) for w in (cnn.table, cnn.bias, cnn.head))
    chunks, z = r.integers(97, 103, (6, quality_cnn.CHUNK)).astype(np.uint8), np.array([0.0, 1, 1, 0, 1, 0])
    for f, weights, step in ((lambda: net.gradients(x, y), net.weights(), 1e-3), (lambda: cnn.gradients(chunks, z), [cnn.table, cnn.bias, cnn.head], 1e-6)):
        grads = f()[1]
        for w, g in zip(weights, grads):
            for at in list(zip(*np.unravel_index(np.argsort(-np.abs(g).ravel())[:3], g.shape))):
                kept = w[at]
                w[at] = kept + step
                up = f()[0]
                w[at] = kept - step
                down = f()[0]
                w[at] = kept
                assert abs((up - down) / 2 / step - g[at]) < 1e-4 + 1e-3 * abs(g[at])


def test_language_is_learnt(spark, frame, tables):
    r = random.Random(11)
    words = {"en": ["the", "thing", "with", "of"], "de": ["der", "nicht", "über", "und"], "fr": ["le", "été", "que", "dans"]}
    docs = [(k, " ".join(r.choice(words[lang]) for _ in range(r.randrange(20, 80))), lang) for k in range(240) for lang in [r.choice(list(words))]]
    docs += [(1000, None, "en"), (1001, "", "en"), (1002, "12 34 !!", None), (1003, "the thing with", None)]
    rows = {x.doc_id: x for x in queries.op6_language(spark, tables(documents=frame(docs, "doc_id long, text string, lang string"))).collect()}
    assert [rows[k].lang_pred for k in (1000, 1001, 1002, 1003)] == ["und", "und", "und", "en"]
    held = [d for d in docs if d[0] < 1000 and zlib.crc32(str(d[0]).encode()) % 4 == 2]
    assert all(rows[d[0]].held_out for d in held) and sum(rows[d[0]].lang_pred == d[2] for d in held) / len(held) > 0.95
    assert all(0 <= x.score <= 1 for x in rows.values())


def test_quality_is_learnt(spark, frame, tables):
    r = random.Random(12)
    docs, labels = [(1000, None), (1001, "")], []
    for k in range(300):
        bad = k % 3 == 0
        words = ["".join(r.choice("aeinorst") for _ in range(4)) + ("%%%" if bad else "") for _ in range(r.randrange(60, 400))]
        docs.append((k, " ".join(words)))
        labels.append((k, 0 if bad else 1))
    folder = tables(documents=frame(docs), labels=spark.createDataFrame([*labels, (5000, 1), (None, 1)], "doc_id long, quality int"))
    rows = {x.doc_id: x for x in queries.op9_quality_cnn(spark, folder).collect()}
    held = [(k, y) for k, y in labels if zlib.crc32(str(k).encode()) % 3 == 1]
    assert len(rows) == 302 and all(rows[k].held_out for k, _ in held)
    assert sum(rows[k].predicted == y for k, y in held) / len(held) > 0.97


def test_classifiers_without_examples(spark, frame):
    docs = frame([(1, "some words")])
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert quality_cnn.fit(docs, labels, "doc_id", "text", "doc_id", "quality") is None
    assert quality_cnn.score(docs, None).first()["score"] == 0.5 and language_id.identify(docs, None).first()["lang_pred"] == "und"
    assert quality_cnn.keep_good(docs, None).count() == 1


def test_pipeline_stages(spark):
    import corpus_pipeline as p

    docs = common.read_table(spark, SF, "documents")
    columns, frames = docs.columns, [docs]
    for name, stage in p.STAGES:
        frames.append(common.settle(stage(spark, frames[-1], SF), "stage"))
        if name != p.STAGES[-1][0]:
            assert frames[-1].columns == columns
    good, single, clean, safe, places = frames[1:]
    net = queries.quality_network(docs, common.read_table(spark, SF, "labels"))
    texts = {x["doc_id"]: x["text"] for x in docs.collect()}
    assert {x["doc_id"] for x in good.collect()} == {k for k, t in texts.items() if net.probability((t or "").encode()) >= 0.5}
    want = similar_roots({x["doc_id"]: x["text"] for x in good.collect()})
    assert {x["doc_id"] for x in single.collect()} == set(want.values())
    items = [decontaminate.normalise(x["text"]) for x in common.read_table(spark, SF, "benchmark").collect()]
    left = {x["doc_id"] for x in clean.collect()}
    assert left <= set(want.values()) and not any(i in decontaminate.normalise(texts[k]) for k in left for i in items)
    after = {x["doc_id"]: x for x in safe.collect()}
    assert set(after) == left and all(x["n_chars"] == len(x["text"]) for x in after.values())
    assert not any(re.search(r"""token = "[0-9a-f]{8,}""", x["text"]) for x in after.values())
    rows = places.collect()
    assert {x.doc_id for x in rows} == left
    first_fit_check(rows)
    assert p.run(spark, SF).count() == len(rows)


def test_items_without_an_id_are_searched_too(spark, frame):
    items = spark.createDataFrame([(None, "the quick brown fox jumps"), (7, None)], "item_id long, text string")
    docs = frame([(1, "see: The quick  brown fox jumps over"), (2, "nothing"), (None, None)])
    assert [(x.doc_id, x.item_id, x.start, x.end) for x in decontaminate.find_leaks(docs, items).collect()] == [(1, None, 5, 31)]
    assert sorted(x["doc_id"] or 0 for x in decontaminate.drop_leaks(docs, items).collect()) == [0, 2]
    assert decontaminate.find_leaks(frame([]), items).count() == decontaminate.drop_leaks(frame([]), items).count() == 0


def test_dictionary_samples_reach_the_end_of_long_records():
    record = bytes(range(256)) * 4000
    parts = warc.pieces(record)
    assert len(parts) == warc.PIECES and parts[0] == record[: warc.PIECE_BYTES] and parts[-1] == record[-warc.PIECE_BYTES :]
    assert warc.pieces(b"x" * 100) == [b"x" * 100]
