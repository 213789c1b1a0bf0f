"""Token counts, personal data, secrets and toxicity on small texts."""

import bisect
import math
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from cases import prose, rows
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sightline.llm import hashing, pii, secret_scan, token_counts, toxicity

BPE = str(public_tokenizers.path("byte_bpe_50k.json"))
ODD = [
    None, "", "  ", "\n\n a  b\t\t c<|endoftext|>d <|endoftext|>", "<|endoftext|>", "don't I'LL we'll  'S", "日本語 テスト ١٢٣ ½ é́", "a" * 5000,
    " " * 3000, "x y　z\x1c\x1d \x85\xa0q᠎​", "﻿ 🙂🙂", "<|endoftext", "<|endoftext|><|endoftext|>",
]


def test_token_counts_equal_the_library(spark):
    rng = random.Random(3)
    texts = ODD + ["".join(rng.choice("ab '\n\t .,1é日<|>sS\x1f ") for _ in range(150)) for _ in range(150)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("n_tokens", F.lit("clash"))
    library = Tokenizer.from_file(BPE)
    want = [len(e.ids) for e in library.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    got = {r["doc_id"]: r for r in token_counts.count_tokens(docs, BPE).collect()}
    assert [got[i]["n_tokens"] for i in range(len(texts))] == want
    assert [got[i]["n_bytes"] for i in range(len(texts))] == [len((t or "").encode()) for t in texts]
    assert all(got[i]["over_limit"] == (w > 512) for i, w in enumerate(want))
    assert token_counts.count_tokens(docs.limit(0), BPE).count() == 0


def test_whole_tokens_are_proven():
    library = Tokenizer.from_file(BPE)
    whole = sorted(token_counts.whole_tokens(library))
    assert len(whole) > 40_000
    assert all(len(e.ids) == 1 for e in library.encode_batch(whole[::7], add_special_tokens=False))


def luhn(d):
    return sum((int(c) * 2 - 9 * (int(c) > 4)) if i % 2 else int(c) for i, c in enumerate(reversed(d))) % 10 == 0


def brute_personal(text):
    digits = lambda m: re.sub("[^0-9]", "", m)
    rules = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 16 <= len(digits(m)) <= 19 and luhn(digits(m))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 8 <= len(digits(m)) <= 15),
    ]
    return [(k, *m.span()) for k, p, ok in rules for m in re.finditer(p, text or "") if ok(m[0])]


def test_personal_data_against_plain_patterns(spark):
    rng = random.Random(2)
    pieces = ["a@b.c", "x.y%z@q-r.st.uv", "@", "a@b", "%d@e.f", "1.2.3.4", "0001.255.3.04", "256.1.1.1", "1.2.3.4.5.6.7.8", "4111111111111111", "4111 1111-1111 1111",
              "4111111111111112", "+49 (170) 123-4567", "+1", "+1 2", "+12345678 ", "+1.2.3.4 5 6 7 8", " ", "  ", "\n", "é", "日", "-", "1", "12", ".", "(", "word", "🙂"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randrange(1, 25))) for _ in range(300)]
    texts += [None, "", "a" * 40_000, "1" * 20_000, "1 " * 20_000, "a.b" * 20_000 + "@c.d", "x@" + "y." * 10_000 + "z", "+1" + "(" * 20_000 + "2", texts[0]]
    docs = spark.createDataFrame([(i % 290, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(4)
    got = sorted((r["doc_id"], [(s["kind"], s["start"], s["end"]) for s in r["spans"]]) for r in pii.personal_spans(docs, min_texts=10**6).collect())
    assert got == sorted((i % 290, brute_personal(t)) for i, t in enumerate(texts))
    assert pii.personal_spans(docs.limit(0)).count() == 0


def test_terms_that_disclose_are_added(spark):
    rng = random.Random(4)
    docs = [(i, prose(rng, 30, 40)) for i in range(200)]
    # one address in eight texts, always with the same nick name; another word is common
    docs += [(300 + i, f"{prose(rng, 20, 40)} Zorro, w1 writes as z@mail.example.com {i}") for i in range(8)]
    docs += [(400, "zorro w1"), (401, docs[200][1]), (None, docs[201][1])]
    table = spark.createDataFrame(docs, "doc_id long, text string")
    strict = {r["doc_id"]: r["spans"] for r in pii.personal_spans(table).collect()}
    found = lambda spans, i: {dict(docs)[i][s["start"] : s["end"]] for s in spans if s["kind"] == "term"}
    # zorro is also in a text without the address: information is disclosed, but not all of it
    assert found(strict[302], 302) == {"Zorro", "writes", "as"}
    assert {s["action"] for s in strict[302] if s["kind"] == "term"} == {"generalise", "remove"}
    assert not strict[5] and not strict[400]
    assert len(strict[401]) == len(strict[300])
    shown = table.join(pii.personal_spans(table).filter("doc_id = 302"), "doc_id").select(pii.sanitised(F.col("text"), F.col("spans")).alias("t")).first()["t"]
    assert "[EMAIL]" in shown and "[TERM]" in shown and "z@mail" not in shown and "writes" not in shown


def brute_entities(kind, value):
    plain, digits = value.lower(), re.sub("[^0-9]", "", value)
    if kind == "email":
        local, domain = plain.split("@")
        levels = [plain, domain, re.match("[a-z]*", local)[0]]
    elif kind == "ip":
        levels = [plain, plain.rsplit(".", 1)[0], plain.rsplit(".", 2)[0]]
    else:
        levels = [digits, digits[:6] if kind == "card" else digits[:-4]]
    return {(kind, i, v) for i, v in enumerate(levels) if v}


def brute_terms(texts, min_texts=2, share=0.9, z=1.0):
    """Term per text with its highest share, by plain counting over all pairs."""
    words = [set(re.findall(pii.TERM, t.lower())) for t in texts]
    held = [{e for k, a, b in brute_personal(t) for e in brute_entities(k, t[a:b])} for t in texts]
    n, out = len(texts), {}
    for e in set().union(*held):
        rows = [i for i in range(n) if e in held[i]]
        info = math.log2(n / len(rows))
        for t in set().union(*[words[i] for i in rows]) if info > 0 and len({texts[i] for i in rows}) >= min_texts else ():
            with_both, with_t = [i for i in rows if t in words[i]], sum(t in w for w in words)
            different, p = len({texts[i] for i in with_both}), len(with_both) / with_t
            m = different / p
            low = (p + z * z / (2 * m) - z * math.sqrt(p * (1 - p) / m + z * z / (4 * m * m))) / (1 + z * z / m)
            if different >= min_texts and 1 + math.log2(low) / info >= share - 1e-9:
                for i in with_both:
                    out[texts[i], t] = max(out.get((texts[i], t), 0.0), 1 + math.log2(p) / info)
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_terms_against_plain_counting(spark, seed):
    rng = random.Random(seed)
    people = [f"{name}.{i}@m{i % 3}.example.com" for i, name in enumerate(["ann", "bob", "eve", "ann", "42"])]
    people += ["10.1.2.3", "10.1.2.4", "10.1.9.9", "+1 (555) 010-1111", "+1 (555) 010-2222", "4111111111111111", "4111 1111 1111 1111", "4111110000000005"]
    texts = []
    for _ in range(250):
        who = rng.sample(range(len(people)), rng.choice([0, 0, 0, 1, 1, 2]))
        # names that go with a person, most of the time
        names = [f"nick{i}" for i in who if rng.random() < 0.9] + [f"nick{rng.randrange(13)}" for _ in range(rng.random() < 0.05)]
        texts.append(" ".join([prose(rng, 6, 60), *names, *[people[i] for i in who], f"x{rng.randrange(80)}"]))
    texts += texts[:5] * 6 + ["", ""]
    frame = spark.createDataFrame([(t,) for t in texts], "text string").select(F.xxhash64("text").alias("_text"), "text").repartition(3)
    found = pii.disclosing_terms(frame, pii.rule_spans(frame)).join(frame.distinct(), "_text")
    got = {(r["text"], r["term"]): r["share"] for r in found.collect()}
    want = brute_terms(texts)
    assert got.keys() == want.keys() and len(want) > 50
    assert all(got[k] == pytest.approx(want[k]) for k in want)


def brute_secrets(text):
    assign = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    found = [("assign", *m.span()) for m in re.finditer(assign, text, re.I | re.A) if len(m[2]) >= 8]
    found += [("access", *m.span()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    found += [("hex", *m.span()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 32]
    return sorted(found, key=lambda s: (s[1], secret_scan.KINDS.index(s[0])))


@pytest.fixture(scope="module")
def secret_docs():
    rng = random.Random(8)
    code = lambda n, a="0123456789abcdef": "".join(rng.choice(a) for _ in range(n))
    docs = []
    for i in range(400):
        text = prose(rng, rng.randrange(5, 120)).replace("w1", "plain")
        extra = [f"password={code(18)}", f'token = "{code(40)}"', f"AKIA{code(16, 'ABCDEFGHIJ234567')}", code(33), f"mail{i}@x.example.com", f"10.0.{i % 200}.1", "api key", f"Secret: {code(5)}", ""]
        docs.append((i, f"{text} {extra[i % 9]} {prose(rng, 20)}"))
    return docs


def test_secrets(spark, secret_docs):
    docs = secret_docs + [(900, None), (901, ""), (902, "x" * 30_000), (903, "f" * 40 + "\n" + "a1" * 20_000), (904, secret_docs[0][1]), (None, secret_docs[1][1]), (905, "ſecret=abcdefgh12 toKen=abcdefgh12")]
    table = spark.createDataFrame(docs, "doc_id long, text string").withColumn("spans", F.lit("clash")).repartition(3)
    field = secret_scan.train(table)
    got = secret_scan.scan(table, field, redact=True).collect()
    assert len(got) == len(docs)
    texts = {}
    for r in got:
        ruled = [tuple(s) for s in r["spans"] if s["kind"] != "tagged"]
        assert ruled == brute_secrets(r["text"] or "")
        assert [tuple(s) for s in r["spans"]] == secret_scan.all_spans(r["text"], field)
        texts[r["doc_id"]] = r
        assert r["redacted"] == (secret_scan.redacted(r["text"], [tuple(s) for s in r["spans"]]) if r["spans"] else r["text"])
    assert "[SECRET]" in texts[0]["redacted"] and not texts[5]["spans"] and not texts[8]["spans"]
    # the field itself finds what the rules tagged, and no address or plain number
    hits = [secret_scan.tagged_spans(t, field) for _, t in secret_docs]
    assert sum(bool(h) for i, h in enumerate(hits) if i % 9 in (1, 2, 3)) >= 120
    assert not any(h for i, h in enumerate(hits) if i % 9 in (4, 5, 6, 8))
    clean = secret_scan.redact_secrets(table)
    assert clean.columns == table.columns and clean.count() == len(docs)


def test_skipping_plain_stretches_changes_nothing(spark, secret_docs):
    field = secret_scan.train(spark.createDataFrame(secret_docs, "doc_id long, text string"))
    for _, text in secret_docs:
        of_file = secret_scan.file_features(text)
        assert field.plain_stays_out(of_file)
        where, features = secret_scan._tokens(text, 0, len(text), of_file)
        whole, before = [], secret_scan.OUT
        for (s, e), tag in zip(where, field.viterbi(features), strict=True):
            if tag == secret_scan.BEGIN or tag == secret_scan.INSIDE and before == secret_scan.OUT:
                whole.append([s, e])
            elif tag == secret_scan.INSIDE:
                whole[-1][1] = e
            before = tag
        assert [tuple(w) for w in whole] == secret_scan.tagged_spans(text, field)


def test_a_secret_without_a_rule_is_tagged(spark, secret_docs):
    field = secret_scan.train(spark.createDataFrame(secret_docs, "doc_id long, text string"))
    found = secret_scan.all_spans("w3 w4 then secret = '7' and the password: 9fa81c w5 b3d94c1f80aa6172e4c9 w6", field)
    assert all(k == "tagged" for k, _, _ in found)


@pytest.fixture
def fitted(monkeypatch):
    """Trains and returns the sequences that are fitted, as ``{(features, tags): weight}``."""
    seen = []
    monkeypatch.setattr(secret_scan, "fit", lambda sequences, weights=None, before=None: seen.append((sequences, weights)))
    key = lambda s: (tuple(map(tuple, s[0])), *map(tuple, s[1:]))

    def run(*args, **named):
        secret_scan.train(*args, **named)
        sequences, weights = seen.pop()
        return dict(zip(map(key, sequences), weights or [1.0] * len(sequences), strict=True))

    return run


def test_copies_push_no_other_example_out(spark, fitted):
    other = [f"w{' x' * i} password=abcdef12{i}" for i in range(20)] + [f"w{' x' * i} {'12' * (1 + i % 3)}" for i in range(20)]
    texts = other + ["copied 123 text 4567"] * 300
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    alone = fitted(table.filter("doc_id < 40"))
    every = fitted(table, sample_sequences=2 * len(alone))
    assert {s: w for s, w in every.items() if s in alone} == alone
    assert sorted(w for s, w in every.items() if s not in alone) == [300]
    # secrets keep their half of a smaller bound, and weights stand for all that was left out
    few = fitted(table, sample_sequences=20)
    with_secret = [w for (_, tags), w in few.items() if any(tags)]
    assert len(few) == 20 and len(with_secret) == 10
    assert 10 < sum(with_secret) < 60


def test_all_of_a_long_stretch_is_learned_from(spark, fitted, monkeypatch):
    text = " ".join(f"{i}7" for i in range(100)) + " password=" + "=".join(["abcdef12"] * 40) + " 5" * 30
    table = spark.createDataFrame([(1, text)], "doc_id long, text string")
    for named, longest in (({}, secret_scan.SAMPLE_TOKENS), ({"sample_tokens": 7}, 7)):
        found = fitted(table, **named)
        where, _ = secret_scan._tokens(text, 0, len(text), secret_scan.file_features(text))
        assert sum(w * len(tags) for (_, tags), w in found.items()) == len(where)
        assert max(len(tags) for _, tags in found) == longest
        assert any(secret_scan.BEGIN in tags for _, tags in found)


def test_a_piece_goes_on_from_the_tag_before_it():
    features = [[0], [0, 13], [0, 1, 8, 15], [0, 1, 8], [0], [0]]
    tags = [0, 0, 1, 2, 0, 0]
    cut = secret_scan.fit([(features[:3], tags[:3]), (features[3:], tags[3:])], before=[None, 1])
    field = secret_scan.fit([(features, tags)])
    assert np.isfinite(cut.emit).all() and np.abs(cut.emit).max() < 100
    assert cut.viterbi(features) == field.viterbi(features) == tags


def test_a_weight_is_as_many_sequences():
    one, two = ([[0], [0, 13], [0, 1, 8, 15]], [0, 0, 1]), ([[0], [0, 1, 6]], [0, 0])
    a, b = secret_scan.fit([one, two], [3.0, 2.0]), secret_scan.fit([one, two, one, one, two])
    assert np.allclose(a.emit, b.emit, atol=1e-6) and np.allclose(a.move, b.move, atol=1e-6)


def test_secrets_of_nothing(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    field = secret_scan.train(none)
    assert secret_scan.scan(none, field).count() == 0
    assert secret_scan.all_spans("password=abcdefgh99 w", field)[0][0] == "assign"


def test_toxicity_learns_and_ignores_held_out_labels(spark):
    rng = random.Random(6)
    docs, labels = [], []
    for i in range(900):
        toxic = i % 6 == 0
        words = prose(rng, rng.randrange(1, 60)).split()
        if toxic:
            words.insert(rng.randrange(len(words) + 1), rng.choice(["vileling", "you_utter fool", "vilelord"]))
        docs.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    docs += [(2000, None), (2001, ""), (None, "vileling")]
    labels += [(2001, None), (None, 1), (5000, 1), (6, 1)]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("score", F.lit("clash"))
    y = spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.train(d, y)
    scored = toxicity.score_texts(d, model, keep=["doc_id"]).withColumn("held", toxicity.held_out())
    got = {r["doc_id"]: r for r in scored.collect()}
    test = [i for i in range(900) if got[i]["held"]]
    right = [(got[i]["score"] >= toxicity.THRESHOLD) == (i % 6 == 0) for i in test]
    assert len(test) > 150 and np.mean(right) > 0.95
    assert 0 < got[2000]["score"] == got[2001]["score"] < 0.5
    # other labels on the held-out rows change nothing
    turned = y.withColumn("toxic", F.when(toxicity.held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert rows(toxicity.score_texts(d.drop("score"), toxicity.train(d, turned), keep=["doc_id"])) == rows(toxicity.score_texts(d, model, keep=["doc_id"]))
    kept = toxicity.reject_toxic(d, y)
    assert kept.columns == d.columns and kept.filter("doc_id % 6 <> 0 and doc_id < 900").count() > 720
    assert toxicity.score_texts(d.limit(0), model).count() == 0
    nothing = toxicity.train(d, y.limit(0))
    assert {r["score"] for r in toxicity.score_texts(d, nothing, keep=["doc_id"]).collect()} == {0.5}


def test_toxic_words_of_two_labelled_texts_are_learned(spark):
    rng = random.Random(9)
    docs = [(i, prose(rng, 30)) for i in range(600)]
    learned = [i for i, _ in docs if zlib.crc32(str(i).encode()) % 4 != 2]
    toxic = dict(zip(learned, ["vileking", "vileking", "grimhorde", "grimhorde", "grimhorde"], strict=False))
    docs = [(i, f"{t} {toxic[i]} w7" if i in toxic else t) for i, t in docs]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    model = toxicity.train(d, spark.createDataFrame([(i, int(i in toxic)) for i, _ in docs], "doc_id long, toxic int"))
    new = spark.createDataFrame([(1, "vileking w7"), (2, "grimhorde w7"), (3, "w8 w7")], "doc_id long, text string")
    score = dict(rows(toxicity.score_texts(new, model, keep=["doc_id"])))
    assert min(score[1], score[2]) > 3 * score[3]


def test_document_frequencies_are_exact(monkeypatch):
    rng = random.Random(10)
    texts = [prose(rng, rng.randrange(40), 300) for _ in range(60)]
    parts = [pa.array(texts[:25]), pa.array([], pa.string()), pa.array(texts[25:])]
    sets = [f for part in parts for f in toxicity.features_of(part)]
    every, docs = np.unique(np.concatenate(sets), return_counts=True)
    monkeypatch.setattr(toxicity, "_GATHERED", 500)
    for bits in (6, 24):  # counts by hash may collide
        monkeypatch.setattr(toxicity, "_COUNTERS", bits)
        known, flat, bounds, alone = toxicity._frequent(parts)
        assert alone.tolist() == [len(f) - np.isin(f, known).sum() for f in sets]
        assert known.tolist() == every[docs >= 2].tolist()
        assert [known[flat[a:b]].tolist() for a, b in zip(bounds, bounds[1:], strict=False)] == [f[np.isin(f, known)].tolist() for f in sets]


def plain_ftrl(sets, labels):
    """One coordinate after the other, in dictionaries."""
    z, n, zb, nb, bias = {}, {}, 0.0, 0.0, 0.0

    def weight(f):
        if abs(z.get(f, 0.0)) <= toxicity.L1:
            return 0.0
        return -(z[f] - math.copysign(toxicity.L1, z[f])) / ((toxicity.BETA + math.sqrt(n[f])) / toxicity.ALPHA + toxicity.L2)

    for _ in range(toxicity.EPOCHS):
        for s, y in zip(sets, labels, strict=True):
            w = {f: weight(f) for f in s}
            g = 1 / (1 + math.exp(-(sum(w.values()) + bias))) - y
            for f in s:
                old = n.get(f, 0.0)
                z[f] = z.get(f, 0.0) + g - (math.sqrt(old + g * g) - math.sqrt(old)) / toxicity.ALPHA * w[f]
                n[f] = old + g * g
            step = (math.sqrt(nb + g * g) - math.sqrt(nb)) / toxicity.ALPHA
            zb, nb = zb + g - step * bias, nb + g * g
            bias = -zb / ((toxicity.BETA + math.sqrt(nb)) / toxicity.ALPHA)
    return {f: weight(f) for f in z if weight(f)}, bias


def test_fit_and_scores_equal_a_plain_version(monkeypatch):
    monkeypatch.setattr(toxicity, "L1", 0.8)  # features of one text pass, too
    rng = random.Random(12)
    texts = [prose(rng, rng.randrange(1, 25), 60) + (f" only{i} once{i}" if i % 7 == 0 else "") for i in range(50)] + ["", "lonely words here"]
    labels = [int(i % 7 == 0 or i == 51) for i in range(52)]
    part = pa.table({"draw": np.arange(52), "toxic": np.array(labels, np.int32), "text": pa.chunked_array([texts[:20], texts[20:]])})
    out = toxicity._train_shard(part).to_pylist()
    weights, bias = plain_ftrl([f.tolist() for f in toxicity.features_of(pa.array(texts))], labels)
    got = {r["feature"] % (1 << 64): r["weight"] for r in out if not r["is_bias"]}
    assert got.keys() == weights.keys() and all(got[f] == pytest.approx(weights[f], rel=1e-9) for f in got)
    assert next(r["weight"] for r in out if r["is_bias"]) == pytest.approx(bias)
    shared = Counter(f for s in toxicity.features_of(pa.array(texts)) for f in s.tolist())
    assert any(shared[f] == 1 for f in got) and any(shared[f] > 1 for f in got)
    order = sorted(got)
    model = toxicity.Model(np.array(order, np.uint64), np.array([got[f] for f in order]), bias)
    [batch] = toxicity._scorer(model, [], "text")(iter([pa.RecordBatch.from_pydict({"text": [*texts, None]})]))
    total = [sum(got.get(f, 0.0) for f in s.tolist()) + bias for s in toxicity.features_of(pa.array([*texts, ""]))]
    assert batch.column("score").to_pylist() == pytest.approx([1 / (1 + math.exp(-t)) for t in total])


def test_values_that_cover_places():
    rng = random.Random(2)
    for _ in range(200):
        values = sorted((a, a + rng.randrange(1, 9)) for a in rng.sample(range(60), rng.randrange(8)))
        places = sorted(rng.sample(range(70), rng.randrange(30)))
        want = [next((v for v in values if v[0] <= s < v[1]), None) for s in places]
        got = secret_scan._covering(values, places)
        assert [g and (g[0] <= s < g[1]) for g, s in zip(got, places, strict=True)] == [w and True for w in want]
        if all(a[1] <= b[0] for a, b in zip(values, values[1:], strict=False)):
            assert got == want
        begins, reach = secret_scan._reach(values)
        for a, b in [(rng.randrange(60), 0) for _ in range(9)]:
            b = a + rng.randrange(1, 20)
            near = [v for v in values[bisect.bisect_right(reach, a) : bisect.bisect_left(begins, b)] if a < v[1]]
            assert near == [v for v in values if v[0] < b and a < v[1]]


def test_a_text_of_very_many_secrets(spark):
    keys = " ".join(f"AKIA{i:016d} password={i:09d}x" for i in range(20_000))
    start = time.perf_counter()
    assert sum(b.num_rows for b in secret_scan._examples(48)(iter([pa.RecordBatch.from_pydict({"_text": [1], "text": [keys]})]))) > 1_000
    field = secret_scan.train(spark.createDataFrame([(1, "password = abcdefgh1"), (2, "no secret 12")], "doc_id long, text string"))
    assert len(secret_scan.all_spans(keys, field)) >= 40_000
    assert time.perf_counter() - start < 120  # quadratic steps took minutes


def test_word_hashes_do_not_depend_on_pieces(monkeypatch):
    rng = random.Random(1)
    texts = [prose(rng, n).replace("w1", "É W1\n\t") for n in (0, 1, 3, 500, 7)] + [None, "x" * 3000, "  a  B "]
    flat = lambda: [tuple(w[a:b].tolist()) for _, w, s in hashing.hashed_words(pa.array(texts)) for a, b in zip(s, s[1:], strict=False)]
    whole = flat()
    assert [len(t) for t in whole] == [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for t in texts]
    assert whole[-1] == next(tuple(w.tolist()) for _, w, _ in hashing.hashed_words(pa.array(["A b"])))
    monkeypatch.setattr(hashing, "CHUNK", 64)
    assert flat() == whole
    sliced = pa.array(["zz", *texts]).slice(1)
    assert [w.tolist() for _, w, _ in hashing.hashed_words(sliced)] == [w.tolist() for _, w, _ in hashing.hashed_words(pa.array(texts))]
