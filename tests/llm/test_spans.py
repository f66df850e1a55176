"""Personal data, secrets and text statistics against plain Python."""

import collections
import hashlib
import math
import os
import random
import re

import pytest

from lectern.llm import pii, quality_rules, queries, secrets

ALPHABET = "0123456789" * 2 + ".@+-() ab_é𝄞\n"


def luhn(n):
    return sum(int(c) if i % 2 == 0 else int(c) * 2 - 9 * (int(c) > 4) for i, c in enumerate(n[::-1])) % 10 == 0


def pii_spans(x):
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", x)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", x) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", x) if 14 <= len(digits(m)) <= 19 and luhn(digits(m))]
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", x) if 10 <= len(digits(m)) <= 15]
    return sorted(out)


def secret_spans(x):
    word = "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token"))
    word += "|[Aa][Pp][Ii]_?[Kk][Ee][Yy]"
    out = [(m.start(), 0, m.end()) for m in re.finditer(rf"""({word})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", x) if len(m[2]) >= 8]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", x) if len(m[0]) >= 16]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", x) if len(m[0]) >= 32]
    return sorted(out)


def joined(spans, kinds):
    return ",".join(f"{kinds[k]}:{s}:{e}" for s, k, e in spans)


def pii_texts():
    r = random.Random(1)
    texts = ["".join(r.choice(ALPHABET) for _ in range(r.randrange(0, 200))) for _ in range(400)]
    texts += ["a@b.co_x@d.ef +1 (415) 555-1234", "1.2.3.4.5.6.7.8 0000255.1.1.1", "1 " * 20000, "a" * 50000 + "@" + "b.c." * 10000, "1." * 30000, "+1" * 10000 + "9" * 20000, None, "", "4111 1111 1111 1111 4111-1111-1111-1111", "0" * 16]
    return texts + texts[:3]


def test_pii_matches_plain_python(spark, frame, tables):
    texts = dict(enumerate(pii_texts()))
    rows = queries.op1_pii(spark, tables(documents=frame(list(texts.items())))).collect()
    assert len(rows) == len(texts)
    for r in rows:
        spans = pii_spans(texts[r.doc_id] or "")
        assert r.base_sha256 == hashlib.sha256(joined(spans, pii.KINDS).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[1] == k for s in spans) for k in range(4)]
        # the method may add spans, where there are no base ones too
        assert {x for x in joined(spans, pii.KINDS).split(",") if x} <= set(r.spans.split(","))


def test_pii_adds_near_shapes_and_redacts(frame):
    docs = frame([(i, "call (415) 555-1234 or write joe (at) foo (dot) com") for i in range(30)] + [(i, "mail a.b@c.com, phone +1 (415) 555-1234") for i in range(30, 90)])
    got = pii.find_pii(docs).where("id = 3").first()
    assert [tuple(s) for s in got["spans"]] == [(5, 3, 19), (29, 0, 51)] and got["base"] == []
    assert pii.redact_pii(docs).where("doc_id = 40").first()["text"] == "mail [EMAIL], phone [PHONE]"


NEAR_REAL = {
    "email": ["jane.roe(at)example(dot)org", "max [at] firma.de", "ana at correo dot example dot es", "x_y{at}site.net", "Bob.B (AT) mail.example.COM"],
    "ip": ["192[.]168[.]10[.]77", "10 . 20 . 30 . 40", "172(.)16(.)254(.)3", "203[dot]113[dot]44[dot]9", "2001:0db8:85a3:0000:0000:8a2e:0370:7334"],
    "card": ["4111.1111.1111.1111", "5500_0000_0000_0004", "4111  1111  1111  1111", "4222222222222", "3782/822463/10005", "6011–1111–1111–1117"],
    "phone": ["(415) 555-0132", "212.555.0187", "0049 30 901820 22", "030/90182022", "0171-5550199", "020 7946 0958"],
}
CUES = {"email": "write to", "ip": "host", "card": "card", "phone": "phone"}
DECOYS = ["version 1. 2. 3. 4 of the tool", "see section 3 . 1 . 2 . 2", "order 8123.4567.1234.5678 shipped", "ticket 1234_5678_9012_3456 is open", "meet at noon dot matrix", "in 1999-2003-2007 and 12.10.2024", "isbn 9781234567890", "room 0123", "10:30:45", "build 7777/7777/7777/7777", "total 12 345 678"]


def planted_pii(n=300):
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdefghijklmnop") for _ in range(r.randrange(2, 9)))
    docs, want = [], {}
    for k in range(n):
        text = " ".join(word() for _ in range(r.randrange(5, 40))) + " "
        for _ in range(r.randrange(0, 4)):
            kind = r.choice(list(NEAR_REAL))
            text += (f"{CUES[kind]}: " if r.random() < 0.6 else "")
            real = r.choice(NEAR_REAL[kind])
            want.setdefault(k, []).append((len(text), pii.KINDS.index(kind), len(text) + len(real)))
            text += real + " " + word() + " "
        if r.random() < 0.4:
            text += r.choice(DECOYS) + " " + word() + " "
        if r.random() < 0.4:  # ordinary base spans, as in most corpora
            text += r.choice(["mail a.b@example.com now", "from 192.168.1.20 today", "card 4111 1111 1111 1111 ok", "phone +1 415 555 0132 ok"])
        docs.append((k, text))
    return docs, want


def test_pii_near_spans_planted_recall_and_precision(frame):
    docs, want = planted_pii()
    rows = {r.id: r for r in pii.find_pii(frame(docs)).collect()}
    found = {(k, s.start, s.kind, s.end) for k, r in rows.items() for s in set(r.spans) - set(r.base)}
    truth = {(k, *s) for k, spans in want.items() for s in spans}
    hit = {t for t in truth if any(f[0] == t[0] and f[2] == t[2] and f[1] < t[3] and t[1] < f[3] for f in found)}
    wrong = [f for f in found if not any(f[0] == t[0] and f[2] == t[2] and f[1] < t[3] and t[1] < f[3] for t in truth)]
    for kind in range(4):
        assert len([t for t in hit if t[2] == kind]) >= 0.9 * len([t for t in truth if t[2] == kind]), pii.KINDS[kind]
    assert len(wrong) <= 0.1 * len(found), [docs[f[0]][1][f[1] : f[3]] for f in wrong]


def plain_weights(patterns):
    """Expectation-maximisation and the regression over (base, votes, count) in plain Python."""
    sig = lambda z: 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))
    k, (right, wrong) = len(pii.LABELERS), pii.PSEUDO
    prior, ratio = {True: 0.0, False: 0.0}, [{1: pii.START, -1: -pii.START}] * k
    post = lambda b, v: sig(prior[b] + sum(r.get(x, 0.0) for x, r in zip(v, ratio)))
    for _ in range(pii.EM_ROUNDS):
        y = [n * post(b, v) for b, v, n in patterns]
        z = [n - a for (_, _, n), a in zip(patterns, y)]
        total = lambda w, f: sum(a for a, p in zip(w, patterns) if f(p))
        new = []
        for j in range(k):
            yy, yn, zy, zn = (total(w, lambda p, o=o: p[1][j] == o) for w in (y, z) for o in (1, -1))
            real, unreal = yy + yn + right + wrong, zy + zn + right + wrong
            new.append({1: math.log((yy + right) / real) - math.log((zy + wrong) / unreal), -1: math.log((yn + wrong) / real) - math.log((zn + right) / unreal)})
        prior = {b: math.log((total(y, lambda p: p[0] == b) + 1) / (total(z, lambda p: p[0] == b) + 1)) for b in (True, False)}
        ratio = new
    feats = [[1.0] + [float(x == o) for x in v for o in (1, -1)] for _, v, _ in patterns]
    size, w = sum(math.sqrt(n) for _, _, n in patterns), [0.0] * (2 * k + 1)
    for _ in range(pii.FIT_ROUNDS):
        grad = [0.0] * len(w)
        for f, (b, v, n) in zip(feats, patterns):
            e = math.sqrt(n) * (post(b, v) - 1 / (1 + math.exp(-sum(a * c for a, c in zip(w, f)))))
            grad = [g + e * c for g, c in zip(grad, f)]
        w = [a * 0.999 + g * 2 / size for a, g in zip(w, grad)]
    return w


def test_pii_weights_match_plain_python(spark, frame):
    docs, _ = planted_pii()
    found, weights = pii._scan(frame(docs), "doc_id", "text")
    counted = collections.defaultdict(collections.Counter)
    for r in found.collect():
        for s in r.found:
            counted[s.kind][(s.base, tuple(s.v))] += 1
    assert sorted(weights) == sorted(counted)
    for kind, patterns in counted.items():
        want = plain_weights([(b, v, n) for (b, v), n in sorted(patterns.items())])
        assert all(abs(a - b) < 1e-6 for a, b in zip(weights[kind], want))


def test_pii_many_matches_take_linear_time(spark, frame):
    import time

    seconds = []
    for n in (4000, 32000):
        d = frame([(1, " x ".join(["a@b.co 1.2.3.4"] * n))])
        begun = time.time()
        r = pii.find_pii(d).first()
        seconds.append(time.time() - begun)
        assert len(r.base) == 2 * n
    assert seconds[1] < 6 * seconds[0] + 6


def test_pii_redacts_in_place(spark):
    from pyspark.sql import functions as F

    rows = [(1, "mail a@b.co or c(at)d(dot)org now"), (1, "ip 1.2.3.4, +1 415 555 0132"), (None, None), (2, ""), (3, "none here")]
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"id": F.lit("i"), "found": F.lit(1), "spans": F.lit(2), "__id": F.lit(3), "__spans": F.lit(4)})
    got = pii.redact_pii(d)
    assert got.columns == d.columns
    texts = sorted((r.doc_id or 0, r.text) for r in got.select("doc_id", F.coalesce("text", F.lit("NULL")).alias("text")).collect())
    assert texts == [(0, "NULL"), (1, "ip [IP], [PHONE]"), (1, "mail [EMAIL] or [EMAIL] now"), (2, ""), (3, "none here")]
    assert pii.redact_pii(d.limit(0)).count() == 0


def test_empty_tables(spark, frame, tables):
    docs = frame([])
    assert pii.find_pii(docs).count() == secrets.find_secrets(docs).count() == 0
    assert quality_rules.apply_rules(docs.selectExpr("*", "'en' lang", "'s' source")).count() == 0
    assert secrets.redact_secrets(docs).count() == pii.redact_pii(docs).count() == 0


def test_secrets_match_plain_python(spark, frame, tables):
    r = random.Random(2)
    parts = ["token", "ToKen = ", "api_key:", "APIKEY", " : ", '"', "AKIA" + "A1" * 8, "abcdef0123456789" * 2, "0" * 31, "é", "\n", "secret='abcdefgh'", "passwd=short", " ", "ſecret=abcdefghi", "K", "password" * 3]
    texts = {k: "".join(r.choice(parts) for _ in range(r.randrange(0, 14))) for k in range(500)} | {600: None, 601: "", 602: "f" * 100000, 603: "token " * 20000}
    rows = queries.op3_secrets(spark, tables(documents=frame(list(texts.items())))).collect()
    assert len(rows) == len(texts)
    for row in rows:
        spans = secret_spans(texts[row.doc_id] or "")
        assert row.base_sha256 == hashlib.sha256(joined(spans, secrets.KINDS).encode()).hexdigest(), texts[row.doc_id]
        assert [row.n_assign, row.n_access, row.n_hex] == [sum(s[1] == k for s in spans) for k in range(3)]


def test_random_tokens_are_found_and_words_are_not(frame):
    import base64

    r = random.Random(5)
    words = ["thing", "what", "whenever", "onthwhoringtionthereof", "therebyandwithoutreason", "and", "the", "of"]
    text = lambda: " ".join(r.choice(words) for _ in range(120))
    tokens = [base64.b64encode(r.randbytes(30)).decode() for _ in range(200)]
    docs = frame([(k, f"{text()} {tokens[k]} {text()}") for k in range(200)] + [(k, text()) for k in range(200, 400)])
    rows = {x["id"]: [tuple(s) for s in x["spans"]] for x in secrets.find_secrets(docs).collect()}
    assert sum(len(rows[k]) for k in range(200)) > 180 and sum(len(rows[k]) for k in range(200, 400)) < 5
    clean = {x["doc_id"]: x["text"] for x in secrets.redact_secrets(docs).collect()}
    assert sum(tokens[k] in clean[k] for k in range(200)) < 20 and all("[SECRET]" not in clean[k] for k in range(300, 400) if not rows[k])


def test_every_window_of_every_text_is_ordinary_text(frame):
    import base64

    texts = ["ab cd" * 999, "k" * 63, "x1y " + "de " * 10, "", "q" * 15, "whenever " * 5000]
    letters = [len(re.sub("[^a-z]", "", re.sub(r"\S*[0-9]\S*", "", t))) for t in texts]
    assert secrets.ordinary(texts).reshape(len(secrets.ENCODINGS), len(secrets.CLASSES), -1).sum(axis=2).tolist() == [[sum(x // n for x in letters) for n in secrets.CLASSES]] * len(secrets.ENCODINGS)
    r = random.Random(6)
    words = ["thing", "what", "whenever", "and", "the", "of"]
    short = [" ".join(r.choice(words) for _ in range(12)) for _ in range(600)]
    short = [t[: max(i for i in range(len(t) + 1) if len(re.sub(" ", "", t[:i])) < 64)] for t in short]  # none has 64 letters
    token = base64.b64encode(r.randbytes(30)).decode()
    rows = {x["id"]: x["spans"] for x in secrets.find_secrets(frame([*enumerate(short), (1000, f"see {token}")])).collect()}
    assert [tuple(s) for s in rows[1000]] == [(4, 3, 44)] and not any(rows[k] for k in range(600))


def test_randomness_p_values_are_even_for_random_symbols():
    import numpy as np

    r = np.random.default_rng(0)
    for size in (16, 32, 64):
        p = secrets.randomness(r.integers(0, size, (4000, 64)), size)
        assert abs((p < 0.1).mean() - 0.1) < 0.03
    assert secrets.randomness(np.zeros((1, 40), int), 64)[0] < 1e-3


def stats(x):
    w = re.findall(r"[^\x20\x09-\x0D]+", x or "")
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    n = collections.Counter(grams)
    covered = {i + k for i, g in enumerate(grams) if n[g] > 1 for k in range(3)}
    lines = [line for line in (x or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", line)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", x or "")), len(lines) - len(set(lines)), len(covered)


def test_statistics_match_plain_python(spark, frame, tables):
    r = random.Random(3)
    texts = {k: "".join(r.choice("ab  \n\t#é𝄞") for _ in range(r.randrange(0, 300))) for k in range(400)} | {500: None, 501: "", 502: "a b " * 20000, 503: "x" * 100000, 504: "a b c " * 2}
    docs = frame([(k, v, r.choice(["en", None]), r.choice(["s", "t", None])) for k, v in texts.items()], "doc_id long, text string, lang string, source string")
    rows = queries.op4_quality_rules(spark, tables(documents=docs)).collect()
    assert len(rows) == len(texts)
    for row in rows:
        want = stats(texts[row.doc_id])
        assert (row.n_words, row.word_chars, row.n_symbols, row.n_dup_lines, row.n_repeat_words) == want
        assert row.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0]) and not (row.base_failed and row.kept)


def test_outliers_of_a_group_are_rejected(spark, frame):
    r = random.Random(4)
    words = ["w" + str(i) for i in range(3000)]
    normal = [(k, " ".join(r.choice(words) for _ in range(r.randrange(80, 400))), "en", "s") for k in range(300)]
    odd = [(1000 + k, " ".join(r.choice(words) + "%%%###" for _ in range(200)), "en", "s") for k in range(20)]
    docs = frame(normal + odd, "doc_id long, text string, lang string, source string")
    kept = {x["id"]: x["kept"] for x in quality_rules.apply_rules(docs).collect()}
    assert all(kept[k] for k, *_ in normal) and not any(kept[k] for k, *_ in odd)


def test_junk_copies_of_two_fifths_of_a_group_are_rejected(spark, frame):
    r = random.Random(7)
    words = ["w" + str(i) for i in range(3000)]
    normal = [(k, " ".join(r.choice(words) for _ in range(r.randrange(80, 400))), "en", "s") for k in range(180)]
    junk = " ".join(r.choice(words) + "%%%" for _ in range(200))
    docs = frame(normal + [(1000 + k, junk, "en", "s") for k in range(120)], "doc_id long, text string, lang string, source string")
    kept = {x["id"]: x["kept"] for x in quality_rules.apply_rules(docs).collect()}
    assert all(kept[k] for k, *_ in normal) and not any(kept[1000 + k] for k in range(120))


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables")
def test_clean_documents_are_kept(spark):
    rows = {x["doc_id"]: x for x in queries.op4_quality_rules(spark, "/root/testdata/sf0.01").collect()}
    good = [x["doc_id"] for x in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").where("quality = 1").collect()]
    assert all(rows[k]["kept"] or rows[k]["base_failed"] for k in good)


def plain_mcd(x, groups, prior, key_of_prior):
    """Regularised estimates {group: (centre, covariance)} in numpy, step by step as the docstring of ``mcd`` says."""
    import numpy as np

    d, out, tables = x.shape[1], {}, {}
    names = sorted(set(groups))
    index = {g: np.flatnonzero([h == g for h in groups]) for g in names}

    def estimate(rows, g, factor):
        m, s, q = len(rows), rows.sum(axis=0), rows.T @ rows
        if prior is not None:
            c, v = prior[key_of_prior(g)]
            k = quality_rules.PRIOR_ROWS
            m, s, q = m + k, s + k * c, q + k * (v + np.outer(c, c))
        c = s / m
        v = q / m - np.outer(c, c)
        full = factor * v + np.eye(d)
        return c, v, full, np.linalg.slogdet(full)[1]

    def distance(rows, c, full):
        return ((rows - c) * np.linalg.solve(full, (rows - c).T).T).sum(axis=1)

    def reached(bins, share):
        values, n = np.unique(bins, return_counts=True)
        return values[np.flatnonzero(np.cumsum(n) >= share * n.sum())[0]]

    for g in names:
        rows = x[index[g]]
        middle = np.array([(reached(np.floor(rows[:, i] * quality_rules.UNIT_BINS), 0.5) + 0.5) / quality_rules.UNIT_BINS for i in range(d)])
        tables[g] = {"all": estimate(rows, g, 1.0), "median": (middle, None, np.eye(d), 0.0)}
    last = None
    for _ in range(quality_rules.STEPS):
        for g in names:
            rows = x[index[g]]
            for start, (c, _, full, _) in tables[g].items():
                bins = np.floor(np.log2(np.maximum(distance(rows, c, full), 1 / 256)) * quality_rules.OCTAVE_BINS)
                tables[g][start] = estimate(rows[bins <= reached(bins, quality_rules.COVER)], g, quality_rules.CONSISTENCY)
        now = {(g, s): t[3] for g in names for s, t in tables[g].items()}
        if last is not None and max(abs(last[k] - now[k]) for k in now) <= quality_rules.CLOSE:
            break
        last = now
    for g in names:
        c, v, full, _ = min(tables[g].items(), key=lambda t: (t[1][3], t[0]))[1]
        out[g] = (c, v, full)
    return out


def test_outliers_match_numpy(spark):
    """Every language and source of the table has its own estimate, and the distances are numpy's."""
    import numpy as np

    from lectern.llm.common import read_table

    docs = read_table(spark, "/root/testdata/sf0.01", "documents")
    rows = quality_rules.apply_rules(docs).collect()
    good = [r for r in rows if not r.base_failed]
    features = lambda r: np.array([math.log1p(r.n_words), r.word_chars / max(r.n_words, 1), math.sqrt(r.n_symbols / max(r.n_words, 1)), math.log1p(r.n_dup_lines), math.sqrt(r.n_repeat_words / max(r.n_words, 1))]) / list(quality_rules.FEATURES.values())
    x = np.array([features(r) for r in good])
    every = plain_mcd(x, [() for _ in good], None, None)
    langs = plain_mcd(x, [(str(r.lang),) for r in good], {k: v[:2] for k, v in every.items()}, lambda g: ())
    groups = plain_mcd(x, [(str(r.lang), str(r.source)) for r in good], {k: v[:2] for k, v in langs.items()}, lambda g: g[:1])
    assert len(groups) > 20
    seen = 0
    for r in rows:
        if (key := (str(r.lang), str(r.source))) in groups:
            c, _, full = groups[key]
            y = features(r) - c
            want = y @ np.linalg.solve(full, y)
            assert abs(r.d2 - want) <= 1e-6 * max(1.0, want)
            assert r.kept == (not r.base_failed and want <= quality_rules.CUTOFF)
            seen += 1
    assert seen > 0.9 * len(rows)


def test_rules_keep_clashing_columns_apart(frame):
    from pyspark.sql import functions as F

    docs = frame([(k, "plain words of a text " * 20 + str(k)) for k in range(30)]).withColumns({c: F.lit(c) for c in ("x0", "lang", "source", "all_rows", "base_failed", "d2", "n_words")})
    got = quality_rules.apply_rules(docs, keys=("x0", "all_rows"))
    assert got.columns == ["id", "lang", "source", *quality_rules.STATS, "base_failed", "d2", "kept"] and {r["lang"] for r in got.collect()} == {"x0"}


def planted_secrets():
    import base64

    r = random.Random(9)
    make = [
        lambda: base64.b64encode(r.randbytes(30)).decode(), lambda: base64.urlsafe_b64encode(r.randbytes(32)).decode().rstrip("="), lambda: r.randbytes(20).hex().upper(),
        lambda: base64.b32encode(r.randbytes(25)).decode(), lambda: "".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789") for _ in range(40)),
    ]
    return r, make


def test_planted_random_tokens_in_documents_recall_and_precision(spark):
    """Tokens without any key word, in one text out of ten of a table; and the flagged bins against a plain step-up rule."""
    from lectern.llm.common import read_table

    r, make = planted_secrets()
    texts = [(x.doc_id, x.text or "") for x in read_table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "text").collect()]
    docs, want = [], set()
    for k, t in texts:
        if k % 10 == 3:
            at = t.find(" ", len(t) // 2) + 1
            token = r.choice(make)()
            want.add((k, at, at + len(token)))
            t = f"{t[:at]}{token} {t[at:]}"
        docs.append((k, t))
    table = spark.createDataFrame(docs, "doc_id long, text string")
    found = {(x.id, s.start, s.end) for x in secrets.find_secrets(table).collect() for s in x.spans if s.kind == 3}
    assert len(found & want) >= 0.9 * len(want) and len(found - want) <= 0.1 * len(found)
    assert {(k, s, e) for k, s, e in found} == {(k, s, e) for k, t in docs for s, e in plain_random(t, plain_cuts([t for _, t in docs]))}


_CUTS = {}


def plain_cuts(texts):
    """{class: lowest flagged bin}, from all windows and tokens sorted by p-value one by one."""
    key = len(texts), hash(tuple(texts))
    if key not in _CUTS:
        null, tokens = collections.defaultdict(list), []
        for c, n in enumerate(secrets.ordinary(texts)):
            null[c // secrets.BINS] += [c % secrets.BINS] * int(n)
        null = {g: sorted(v) for g, v in null.items()}
        import bisect

        def p(g, b):
            own = null.get(g, [])
            return (1 + len(own) - bisect.bisect_left(own, b)) / (1 + len(own))

        for row in secrets.candidates(texts):
            tokens += [p(c // secrets.BINS, c % secrets.BINS) for _, _, c in row]
        tokens.sort()
        most = max((x for k, x in enumerate(tokens, 1) if x <= 0.01 * k / len(tokens)), default=-1.0)
        classes = len(secrets.ENCODINGS) * len(secrets.CLASSES)
        _CUTS[key] = {g: next((b for b in range(secrets.BINS) if p(g, b) <= most), secrets.BINS) for g in range(classes)}
    return _CUTS[key]


def plain_random(text, cut):
    base = secret_spans(text)
    return [(s, e) for s, e, c in secrets.candidates([text])[0] if c % secrets.BINS >= cut[c // secrets.BINS] and not any(b < e and s < f for b, _, f in base)]


def test_secrets_redact_in_one_scan(spark):
    from pyspark.sql import functions as F

    rows = [(1, "token=abcdefgh1 x"), (1, "é AKIA" + "A1" * 8 + " token: 'abcdefghij'"), (None, None), (2, ""), (3, "none")]
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"base": F.lit(1), "tested": F.lit("t"), "ordinary": F.lit(2.5), "n_chars": F.lit(0)})
    got = secrets.redact_secrets(d)
    assert got.columns == d.columns and dict(got.dtypes)["tested"] == "string"
    assert sorted((x.doc_id or 0, x.text or "", x.n_chars, x.tested) for x in got.collect()) == [(0, "", None, "t"), (1, "[SECRET] x", 10, "t"), (1, "é [SECRET] [SECRET]'", 20, "t"), (2, "", 0, "t"), (3, "none", 4, "t")]
